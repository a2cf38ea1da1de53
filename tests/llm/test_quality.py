import re
from collections import Counter

import numpy as np

from tabula.llm import quality, textbytes
from tabula.llm.queries import QUERIES
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] >= 2 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, documents):
    long_text = "wörd " * 200_000
    odd = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "a\n\na\na b"), (-5, "é ü\x0bx\x0cy #|"), (-6, long_text), (-1, None), (None, "the same five words here the same five words here now")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = quality.document_statistics(docs).toPandas()
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda r: tuple(-(10**9) if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, got[cols].itertuples(index=False))) == sorted(map(key, want))


def test_rows_across_slices(monkeypatch, documents):
    import pyarrow as pa

    texts = [r.text for r in documents.limit(60).collect()] + [None, ""]
    whole = quality.statistics(textbytes.texts_of(pa.array(texts, pa.string())))
    monkeypatch.setattr(textbytes, "HASH_SPAN", 64)
    parts = [quality.statistics(t) for _, _, t in textbytes.slices(textbytes.texts_of(pa.array(texts, pa.string())), 500)]
    for k, v in whole.items():
        assert (v == np.concatenate([p[k] for p in parts])).all(), k


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (rng.random(4000) < 0.05)).astype(float) * (x[:, 1] < 0.8)
    model = quality.fit(x, y, [1, -1, 0])
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.93
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, 0).reshape(50, 40, 3)
        grid[:, :, f] = np.linspace(0, 1, 40)
        p = model.margin(grid.reshape(-1, 3)).reshape(50, 40)
        assert (np.diff(p, axis=1) * sign >= -1e-12).all()


def test_constant_models():
    none = quality.fit(np.zeros((0, 2)), np.zeros(0), [0, 0])
    assert none.probability(np.zeros((3, 2))).tolist() == [0.5] * 3
    one = quality.fit(np.ones((9, 2)), np.ones(9), [0, 0])
    assert (one.probability(np.ones((2, 2))) > 0.9).all()


def test_query(spark, documents):
    got = QUERIES["op9_quality_trees"](spark, SF_SMALL).toPandas()
    assert len(got) == documents.count()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (both.kept == (both.quality == 1)).mean() > 0.85
    assert not got[got.base_failed].kept.any()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words long, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_filter(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "some words that are long enough to pass the rules of all here", 5)], "doc_id long, text string, quality_score int")
    assert quality.quality_filter(one, labels).first().kept


def test_several_labels_of_one_id_teach_their_mean(spark):
    docs = spark.createDataFrame([(k, ("good words of a text " * 4 if k % 2 else "# # # x ") * (1 + k % 5)) for k in range(60)], "doc_id long, text string")
    counts = quality.document_statistics(docs, "doc_id", "text")
    rows = [(k, k % 2) for k in range(60)] + [(k, 1 - k % 2) for k in range(0, 60, 7)]
    models = [quality.train(counts, spark.createDataFrame(r, "doc_id long, quality int").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert all((getattr(models[0], f) == getattr(models[1], f)).all() for f in ("feature", "threshold", "left", "right", "value", "root"))
