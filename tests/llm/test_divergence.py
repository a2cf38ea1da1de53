import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tabula.llm import divergence, textbytes
from tabula.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def small(spark, n=300):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "zeta", "eta", "w0rd", "x_y", "日本"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12), p=rng.dirichlet(np.ones(10)))) + "!" * (k % 3), ["en", "de", None, ""][k % 4], f"s{k % 7}" if k % 11 else None, "clash", k) for k in range(n)]
    rows += [(None, "en", "s1", "c", 1), ("", "only", "one", "c", 2), ("beta " * 5000, "en", "s2", "c", 3), ("beta", "en", "quiet", "c", 3), (None, "en", "mute", "c", 4)]
    return spark.createDataFrame(rows, "text string, lang string, source string, item string, value long")


def test_equals_brute_force(spark):
    docs = small(spark)
    rows = [tuple(r[:3]) for r in docs.collect()]
    for least, top in ((30, 50), (3, 2), (10_000, 50)):
        assert rows_of(divergence.audit(docs, min_docs=least, top=top)) == brute(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_many_blocks_and_parts(spark, monkeypatch):
    docs = small(spark)
    want = brute([tuple(r[:3]) for r in docs.collect()], 3, 50)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 9)
    monkeypatch.setattr(divergence, "BLOCK_PLACES", 20)
    assert rows_of(divergence.audit(docs, min_docs=3)) == want


def test_accumulators_equal_the_full_sum():
    rng = np.random.default_rng(1)
    groups, terms = 9, 40
    base = rng.integers(1, 50, groups)
    full = np.tile(base[:, None], (1, terms))
    has = rng.random((groups, terms)) < 0.3
    has[4] = False
    full[has] += rng.integers(0, 100, has.sum())
    g, t = np.nonzero(has)
    rows = np.array([0, 3, 4, 8])
    got = divergence.accumulate(g, t, full[has], base, rows)
    for k, r in enumerate(rows):
        want = [sum(abs(full[r, x] - full[h, x]) for x in range(terms) if has[r, x] or has[h, x]) for h in range(groups)]
        # a term of both was counted for each side and once taken back with the base difference
        both = [sum(abs(base[r] - base[h]) for x in range(terms) if has[r, x] and has[h, x]) for h in range(groups)]
        assert got[k].tolist() == [a + b for a, b in zip(want, both, strict=True)]


def test_accumulators_of_a_few_rows_take_bounded_memory():
    """Sums over the values of all groups were made for all groups before a task took its own rows."""
    rng = np.random.default_rng(2)
    groups = 3000
    base, g, t = rng.integers(1, 50, groups), np.arange(groups), np.arange(groups) % 7
    share = base + rng.integers(0, 100, groups)
    tracemalloc.start()
    got = divergence.accumulate(g, t, share, base, np.array([1, 2500]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    for k, r in enumerate((1, 2500)):
        # the term of both groups, or their two terms; see above for terms of both
        same = np.abs(share[r] - share) + np.abs(base[r] - base)
        two = np.abs(share[r] - base) + np.abs(share - base[r])
        want = np.where(t == t[r], same, two)
        assert np.delete(got[k], r).tolist() == np.delete(want, r).tolist()


def test_a_batch_of_texts_takes_bounded_memory(spark, monkeypatch):
    """A worker cut 16 MB of text at once, in some 250 MB of numbers, and kept the freed memory."""
    runs, back = [], []
    docs = spark.createDataFrame([("en", "s", "a")], "lang string, source string, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: runs.append(run))
    monkeypatch.setattr(textbytes, "give_back", lambda: back.append(1))
    divergence.term_rows(docs, *(docs[c] for c in docs.columns))
    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + int(c)) for c in f"{k:05}") for k in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(6000)] + ["", "1 2"] * 500
    lang, source = ["de", "en"] * 3500, [f"s{k % 3}" for k in range(7000)]
    batch = pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(texts)], names=docs.columns)
    tracemalloc.start()
    got = list(runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20 and back == [1]
    want, n, of = defaultdict(Counter), Counter(), Counter()
    for at, text in enumerate(texts):
        want[lang[at], source[at]].update(TERM.findall(text))
        of.update((lang[at], source[at], w) for w in set(TERM.findall(text)))
    sums = Counter()
    for b in got:
        for a, s, w, k, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n[a, s, w] += k
            sums[a, s, w] += d
    assert n == Counter({(*g, w): k for g, c in want.items() for w, k in c.items()}) and sums == of


def test_counts_of_many_slices_are_added_up(spark, monkeypatch):
    docs = small(spark)
    want = brute([tuple(r[:3]) for r in docs.collect()], 3, 50)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 40)
    monkeypatch.setattr(divergence, "SENT_ROWS", 7)
    assert rows_of(divergence.audit(docs, min_docs=3)) == want


def test_texts_are_read_once(spark, monkeypatch):
    cut, terms = spark.sparkContext.accumulator(0), divergence.term_rows

    def counted(docs, lang, source, text):
        def tick(batches):
            for batch in batches:
                cut.add(batch.num_rows)
                yield batch

        return terms(docs.mapInArrow(tick, docs.schema), lang, source, text)

    monkeypatch.setattr(divergence, "term_rows", counted)
    docs = small(spark)
    assert divergence.audit(docs, min_docs=3).count() and cut.value == docs.count()


def test_query_equals_sql(spark, duck):
    got = rows_of(QUERIES["op13_source_divergence"](spark, SF_SMALL))
    assert got == set(duck.execute(ORACLE["op13_source_divergence"]).fetchall()) and got
