"""URL filter: host rules, and a character language-model ratio where no rule fits.

URLs that a rule allows or blocks teach two character models. Each is a Markov model
of variable order 0 .. 2 (every order smoothed into the next by Witten-Bell's
weights) over a closed alphabet, so a model is at most ALPHABET ** 3 numbers
whatever the data: counting is one aggregate with that many groups at most, and
the table of log-likelihood ratios may be broadcast. A URL's score is the mean ratio
of its characters; each distinct URL is scored once, by three-symbol codes joined
with the table. The threshold is calibrated on labelled URLs the models haven't seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabula.llm.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0/.-_?=&#:%" + "*^"
"""0 stands for any digit, * for any other character, ^ for the place before the first."""

ALPHABET = len(SYMBOLS)
STEPS = 200
MOST = 20 * STEPS
"""Calibration counts scores in steps of 1 / STEPS, beyond +-20 in the last."""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule (``host/path``) whose host is the URL's or a parent of it and whose path
    begins the URL's; of equally long ones the first by name. Null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest), rule).otherwise(out)
    return out


def coded(url: Column) -> Column:
    """The URL in SYMBOLS."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789^*", LOWER + "0" * 9 + "~~")
    return F.regexp_replace(low, "[^a-z0/.\\-_?=&#:%]", "*")


def _part(url: Column) -> Column:
    """0 .. 4 from the URL alone: part 0 calibrates, the others teach."""
    return F.pmod(F.conv(F.substring(F.md5(url), 1, 2), 16, 10).cast("int"), F.lit(5))


def _probability(grams: DataFrame, key: list[str], given: list[str], lower: DataFrame | None) -> DataFrame:
    """Witten-Bell over the counts ``n`` of one order: key columns and ``p``."""
    n = grams.groupBy(*key).agg(F.sum("n").alias("n"))
    if lower is None:
        total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
        every = grams.sparkSession.range(ALPHABET).select(F.col("id").cast("int").alias("c"))
        return every.join(n, "c", "left").select("c", ((F.coalesce("n", F.lit(0)) + 1) / (total.scalar() + ALPHABET)).alias("p"))
    context = n.groupBy(*given).agg(F.sum("n").alias("m"), F.count("*").alias("kinds"))
    every = context.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(ALPHABET - 1))))  # each symbol after each context seen
    every = every.join(n, key, "left").join(lower, [k for k in key if k in lower.columns])
    return every.select(*key, ((F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("m") + F.col("kinds"))).alias("p"))


def _table(grams: DataFrame) -> DataFrame:
    """(a, b, c, p): the probability of every symbol after every two, from counts (a, b, c, n)."""
    p0 = _probability(grams, ["c"], [], None)
    p1 = _probability(grams, ["b", "c"], ["b"], p0)
    full1 = _every(grams, 2).join(p1, ["b", "c"], "left").join(p0.withColumnRenamed("p", "q"), "c").select("b", "c", F.coalesce("p", "q").alias("p"))
    p2 = _probability(grams, ["a", "b", "c"], ["a", "b"], full1)
    return _every(grams, 3).join(p2, ["a", "b", "c"], "left").join(full1.withColumnRenamed("p", "q"), ["b", "c"]).select("a", "b", "c", F.coalesce("p", "q").alias("p"))


def _every(df: DataFrame, order: int) -> DataFrame:
    """All (a, b, c) or (b, c)."""
    g, k = F.col("id"), ALPHABET
    codes = [F.floor(g / (k * k)).cast("int").alias("a"), F.pmod(F.floor(g / k), F.lit(k)).cast("int").alias("b"), F.pmod(g, F.lit(k)).cast("int").alias("c")]
    return df.sparkSession.range(k**order).select(*codes[3 - order :])


def _grams(urls: DataFrame) -> DataFrame:
    """A row with three symbols' codes (a, b, c) for every character of ``symbols``."""
    text = urls.withColumn("s", F.concat(F.lit("^^"), "symbols")).withColumn("k", F.explode(F.sequence(F.lit(3), F.length("s"))))
    code = lambda back: F.instr(F.lit(SYMBOLS), F.substring("s", F.col("k") - back, F.lit(1))) - 1
    return text.where(F.length("symbols") > 0).select(*urls.columns, code(2).alias("a"), code(1).alias("b"), code(0).alias("c"))


def ratios(urls: DataFrame) -> DataFrame:
    """(a, b, c, r), ALPHABET ** 3 rows: the log-likelihood ratio of symbol c after a and b;
    ``urls`` has ``symbols`` and ``accepted``."""
    grams = stored(_grams(urls).groupBy("accepted", "a", "b", "c").agg(F.count("*").alias("n")), "grams")
    good, bad = _table(grams.where("accepted")), _table(grams.where("not accepted")).withColumnRenamed("p", "q")
    return stored(good.join(bad, ["a", "b", "c"]).select("a", "b", "c", F.log(F.col("p") / F.col("q")).alias("r")), "ratios")


def scores(urls: DataFrame, table: DataFrame) -> DataFrame:
    """(symbols, score): the mean ratio along each distinct non-empty coded URL."""
    each = _grams(urls.select("symbols").distinct())
    return each.join(F.broadcast(table), ["a", "b", "c"]).groupBy("symbols").agg(F.avg("r").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the step of ``score`` at which false allowed and false blocked shares add up to
    least, the lowest of equal ones; null without URLs of both kinds."""
    step = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-MOST)), F.lit(MOST))
    bins = scored.groupBy(step.alias("step")).agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad"))
    # at most 2 * MOST + 1 rows
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wrong = F.coalesce(F.sum("good").over(below), F.lit(0)) / F.nullif(F.sum("good").over(every), F.lit(0)) + 1 - F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.nullif(F.sum("bad").over(every), F.lit(0))
    # in billionths, so that equal errors are equal
    cost = bins.select("step", F.round(wrong * 1e9).cast("long").alias("wrong"))
    return cost.where("wrong is not null").agg((F.min_by("step", F.struct("wrong", "step")) / STEPS).alias("threshold"))


def filter_urls(pages: DataFrame, rules: dict[str, bool], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row with ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` maps ``host/path`` to True (allow) or False (block). The verdict is the rule's, else
    allow where the score reaches the threshold. Without labelled URLs of both kinds all
    others are allowed. A null URL is judged like an empty one (score 0). Repeated rows are
    judged alike; columns of the four names are replaced; an empty table gives an empty result.
    """
    cols = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("symbols", coded(F.col("url")))
    allowed = [r for r, ok in rules.items() if ok]
    known = judged.where(F.col("rule").isNotNull() & F.col("url").isNotNull()).select("url", "symbols", F.col("rule").isin(allowed).alias("accepted"))
    table = ratios(known.where(_part(F.col("url")) != 0))
    held = known.where(_part(F.col("url")) == 0)
    least = threshold(held.join(scores(held, table), "symbols")).scalar()
    new = scores(judged.where(F.col("rule").isNull()), table)
    judged = judged.join(new, "symbols", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when(least.isNull() | (F.col("score") >= least), "allow").otherwise("block")
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model)
    return judged.select(*[F.col("row")[c].alias(c) for c in cols], "host", "path", "rule", verdict.alias("verdict"))
