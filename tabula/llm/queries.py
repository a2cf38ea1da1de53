"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm import bottomk, divergence, html_crf, langid, mixing, nndescent, packing, pii, preference, quality, runs, toxicity, url_lm
from tabula.llm.labelled_pages import labelled_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = {"com/": True, "example.com/en/": False, "www.example.com/en/": True, "net/es/": False, "net/fr/": False}


def op1_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


LABELLED_SEED = 1


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_crf.train(labelled_pages(html_crf.TRAIN_PAGES, LABELLED_SEED))
    return html_crf.extract(_table(spark, sf_dir, "pages"), model, keep=["page_id", "url"])


PII_KEY = "tabula-surrogates"
"""The key is a parameter of the operator; a real corpus takes a secret one."""


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_language_hypervectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = langid.train(docs.where(~held_out))
    got = langid.predict(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


MIX_TARGETS = {
    "source": {f"src{k}": 0.1 if k == 0 else 0.045 for k in range(20)},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15},
    "topic": {"prose": 0.7, "contact": 0.1, "table": 0.1, "markup": 0.1},
}
MIX_SHARE = 0.5


def mix_dimensions() -> dict[str, Column]:
    """The query's source, language and topic of a document; topics by what its text holds."""
    text = F.col("text")
    topic = F.when(text.contains(" | "), "table").when(text.rlike("[#*$%&]"), "markup").when(text.rlike("[@0-9]"), "contact").when(text.isNotNull(), "prose")
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"), mix_dimensions(), MIX_TARGETS, MIX_SHARE, keep=["doc_id"])
    return got.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.tokens", "mix.probability", "mix.drawn")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def tokenizer_file() -> str:
    """The public vocabulary file, on the machine that asks."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file)


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, all turns, against itself with a stale reply at a hashed place."""
    talks = preference.conversations(_table(spark, sf_dir, "conversations"))
    got = preference.format_preferences(preference.with_stale_reply(talks))
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return got.select("conv_id", "prompt", "prompt_turns", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def planted_repetitions() -> Column:
    """The text, or for ids whose CRC-32 is a multiple of ten its words with a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    root = F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))
    planted = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(F.flatten(root), F.lit(1), (n - a).cast("int")))
    return F.when(h % 10 != 0, F.col("text")).when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", planted_repetitions().alias("text")))
    # runs come by start, then period: of equal exponents the first one stays
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    first = F.get(F.col("runs"), F.lit(0))
    best = F.aggregate("runs", first, more)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return got.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


TOXIC_FROM = 0.7


def op12_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    got = toxicity.score(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_language_model": op1_url_language_model,
    "op2_html_main_text": op2_html_main_text,
    "op3_surrogates": op3_surrogates,
    "op4_language_hypervectors": op4_language_hypervectors,
    "op5_raked_mixture": op5_raked_mixture,
    "op6_nn_descent": op6_nn_descent,
    "op7_minhash_bottom_k": op7_minhash_bottom_k,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_quality_trees": op9_quality_trees,
    "op10_preference_format": op10_preference_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity_grammar": op12_toxicity_grammar,
    "op13_source_divergence": op13_source_divergence,
}


_URL_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789^*', 'abcdefghijklmnopqrstuvwxyz000000000~~'), '[^a-z0/.\-_?=&#:%]', '*', 'g') AS symbols
  FROM pages),
judged AS (SELECT *, {rule} AS rule FROM parsed),
known AS (SELECT symbols, rule IN ({allowed}) AS accepted, ('0x' || md5(url)[1:2])::INT % 5 AS part FROM judged WHERE rule IS NOT NULL AND url IS NOT NULL),
chars AS (SELECT symbols, accepted, unnest(range(3, length(symbols) + 3)) AS k, '^^' || symbols AS s FROM known WHERE part <> 0),
grams AS (SELECT accepted, s[k - 2] AS a, s[k - 1] AS b, s[k] AS c, count(*) AS n FROM chars GROUP BY ALL),
symbol AS (SELECT unnest(string_split({symbols}, '')) AS c),
class AS (SELECT unnest([true, false]) AS accepted),
n0 AS (SELECT accepted, c, sum(n) AS n FROM grams GROUP BY ALL),
p0 AS (SELECT class.accepted, symbol.c, (coalesce(n0.n, 0) + 1) / (coalesce((SELECT sum(n) FROM grams g WHERE g.accepted = class.accepted), 0) + {size})::DOUBLE AS p
       FROM class CROSS JOIN symbol LEFT JOIN n0 ON n0.accepted = class.accepted AND n0.c = symbol.c),
n1 AS (SELECT accepted, b, c, sum(n) AS n FROM grams GROUP BY ALL),
m1 AS (SELECT accepted, b, sum(n) AS m, count(*) AS kinds FROM n1 GROUP BY ALL),
p1 AS (SELECT p0.accepted, s.c AS b, p0.c, CASE WHEN m1.m IS NULL THEN p0.p ELSE (coalesce(n1.n, 0) + m1.kinds * p0.p) / (m1.m + m1.kinds)::DOUBLE END AS p
       FROM p0 CROSS JOIN symbol s LEFT JOIN m1 ON m1.accepted = p0.accepted AND m1.b = s.c LEFT JOIN n1 ON n1.accepted = p0.accepted AND n1.b = s.c AND n1.c = p0.c),
m2 AS (SELECT accepted, a, b, sum(n) AS m, count(*) AS kinds FROM grams GROUP BY ALL),
p2 AS (SELECT p1.accepted, s.c AS a, p1.b, p1.c, CASE WHEN m2.m IS NULL THEN p1.p ELSE (coalesce(g.n, 0) + m2.kinds * p1.p) / (m2.m + m2.kinds)::DOUBLE END AS p
       FROM p1 CROSS JOIN symbol s LEFT JOIN m2 ON m2.accepted = p1.accepted AND m2.a = s.c AND m2.b = p1.b
       LEFT JOIN grams g ON g.accepted = p1.accepted AND g.a = s.c AND g.b = p1.b AND g.c = p1.c),
ratios AS (SELECT x.a, x.b, x.c, ln(x.p / y.p) AS r FROM p2 x JOIN p2 y ON x.accepted AND NOT y.accepted AND x.a = y.a AND x.b = y.b AND x.c = y.c),
places AS (SELECT symbols, unnest(range(3, length(symbols) + 3)) AS k, '^^' || symbols AS s FROM (SELECT DISTINCT symbols FROM judged)),
scores AS (SELECT symbols, avg(r) AS score FROM places JOIN ratios ON a = s[k - 2] AND b = s[k - 1] AND c = s[k] GROUP BY ALL),
bins AS (SELECT least(greatest(floor(score * {steps}), -{most}), {most}) AS step, sum(accepted::INT) AS good, sum((NOT accepted)::INT) AS bad FROM known JOIN scores USING (symbols) WHERE part = 0 GROUP BY ALL),
cost AS (SELECT step, round((coalesce(sum(good) OVER below, 0) / nullif(sum(good) OVER (), 0)::DOUBLE + 1 - coalesce(sum(bad) OVER below, 0) / nullif(sum(bad) OVER (), 0)::DOUBLE) * 1e9) AS wrong
         FROM bins WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least AS (SELECT (SELECT step / {steps} FROM cost WHERE wrong IS NOT NULL ORDER BY wrong, step LIMIT 1) AS t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN t IS NULL OR coalesce(score, 0) >= t THEN 'allow' ELSE 'block' END AS verdict
FROM judged LEFT JOIN scores USING (symbols), least
"""


def url_sql() -> str:
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in sorted(URL_RULES, key=len, reverse=True)) + " END"
    fills = {"rule": rule, "allowed": ", ".join(f"'{r}'" for r, ok in URL_RULES.items() if ok), "symbols": f"'{url_lm.SYMBOLS}'", "size": url_lm.ALPHABET, "steps": f"{url_lm.STEPS}.0::DOUBLE", "most": url_lm.MOST}
    out = _URL_SQL
    for k, v in fills.items():
        out = out.replace("{" + k + "}", str(v))
    return out

# the pairs of the query differ in their last turn alone, or not at all
PREFERENCE_SQL = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM rows),
replies AS (SELECT conv_id, pos, text, lag(text) OVER w AS earlier, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM ranked WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
drawn AS (SELECT conv_id, pos AS drawn_pos, CASE WHEN k > 1 THEN earlier ELSE regexp_extract(text, '^[^.!?]*[.!?]?', 0) END AS stale FROM replies WHERE k = 1 + ('0x' || md5(conv_id::VARCHAR)[1:8])::BIGINT % n),
sides AS (SELECT r.conv_id, pos, side, role, CASE WHEN side = 'b' AND pos = drawn_pos THEN stale ELSE text END AS text,
                 CASE WHEN drawn_pos IS NOT NULL AND pos >= drawn_pos AND (SELECT text FROM ranked x WHERE x.conv_id = r.conv_id AND x.pos = drawn_pos) IS DISTINCT FROM stale THEN 1 ELSE 0 END AS after
          FROM ranked r LEFT JOIN drawn USING (conv_id), (VALUES ('a'), ('b')) s(side)),
shown AS (SELECT *, '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS tail FROM sides),
placed AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, side, after ORDER BY pos) AS stop FROM shown),
told AS (SELECT conv_id, side, after, count(*) AS n, string_agg(head || tail, '' ORDER BY pos) AS txt, string_agg((stop - length(tail))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask FROM placed GROUP BY ALL)
SELECT conv_id, coalesce(max(txt) FILTER (WHERE side = 'a' AND after = 0), '') AS prompt, coalesce(max(n) FILTER (WHERE side = 'a' AND after = 0), 0) AS prompt_turns,
       coalesce(max(txt) FILTER (WHERE side = 'a' AND after = 1), '') AS chosen, coalesce(max(txt) FILTER (WHERE side = 'b' AND after = 1), '') AS rejected,
       coalesce(max(mask) FILTER (WHERE side = 'a' AND after = 1), '') AS chosen_mask, coalesce(max(mask) FILTER (WHERE side = 'b' AND after = 1), '') AS rejected_mask
FROM told GROUP BY conv_id
"""


def mix_sql(rounds: int = 60) -> str:
    """Raking in SQL: a fixed number of rounds, past convergence."""
    place = lambda d, col: f"CASE WHEN {col} IN ({', '.join(repr(v) for v in MIX_TARGETS[d])}) THEN {col} ELSE '*' END AS {d}"
    topic = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#*$%&]') THEN 'markup' WHEN regexp_matches(text, '[@0-9]') THEN 'contact' WHEN text IS NOT NULL THEN 'prose' ELSE '*' END AS topic"
    parts = [
        f"docs AS (SELECT doc_id, {place('source', 'source')}, {place('lang', 'lang')}, {topic}, "
        r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens, "
        "('0x' || md5('mix' || chr(1) || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
    ]
    for d, target in MIX_TARGETS.items():
        rows = ", ".join(f"({v!r}, {s!r}::DOUBLE)" for v, s in [*target.items(), ("*", max(0.0, 1 - sum(target.values())))])
        parts.append(f"want_{d} AS (SELECT v, s / sum(s) OVER () AS s FROM (VALUES {rows}) t(v, s) WHERE v IN (SELECT {d} FROM cells GROUP BY 1 HAVING sum(tokens) > 0))")
    parts.append(
        "r0 AS (SELECT c.*, c.tokens / sum(c.tokens) OVER () AS w, coalesce(a.s, 0) AS t_source, coalesce(b.s, 0) AS t_lang, coalesce(d.s, 0) AS t_topic FROM cells c "
        "LEFT JOIN want_source a ON a.v = c.source LEFT JOIN want_lang b ON b.v = c.lang LEFT JOIN want_topic d ON d.v = c.topic)"
    )
    last = "r0"
    for k in range(1, rounds + 1):
        for d in MIX_TARGETS:
            parts.append(f"r{k}_{d} AS (SELECT * REPLACE (CASE WHEN w > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = f"r{k}_{d}"
    parts += [
        f"ratios AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM {last})",
        f"steps AS (SELECT *, ({MIX_SHARE} * sum(tokens) OVER () - (sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic) - tokens)) / sum(w) OVER (ORDER BY ratio, source DESC, lang DESC, topic DESC) AS f FROM ratios)",
        "factor AS (SELECT min_by(f, -ratio) FILTER (WHERE f * ratio <= 1) AS f FROM steps)",
        "chances AS (SELECT source, lang, topic, round(CASE WHEN ratio > 0 THEN least(1.0, coalesce(factor.f * ratio, 1.0)) ELSE 0 END, 6) AS probability FROM ratios, factor)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, d.source, d.lang, d.topic, d.tokens, probability, u < probability AS drawn FROM docs d JOIN chances c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic"


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT r, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 30),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM cells),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


ORACLE: dict[str, str] = {
    "op1_url_language_model": url_sql(),
    "op5_raked_mixture": mix_sql(),
    "op10_preference_format": PREFERENCE_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
