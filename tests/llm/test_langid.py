import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabula.llm import langid, textbytes
from tabula.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def brute_bundle(text, dimension):
    letters = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    while "  " in letters:
        letters = letters.replace("  ", " ")
    total = np.zeros(dimension)
    for i in range(len(letters) - 2):
        gram = letters[i : i + 3]
        if gram[1] != " ":
            total += langid.gram_vectors(np.array([[ord(c) for c in gram]], np.uint32), dimension)[0]
    return total


def test_bundles_equal_brute_force():
    texts = ["The Übung, is 12 here!", "", "a", "ñandú и слово", "x" * 50]
    t = textbytes.texts_of(pa.array(texts))
    row, index, grams, letters = langid.trigrams(t)
    got = langid.bundles(row, index, grams, len(texts), 64)
    assert letters.tolist() == [sum(c.isalpha() for c in x) for x in texts]
    for k, x in enumerate(texts):
        assert (got[k] == brute_bundle(x, 64)).all(), x


def test_sorted_and_tabled_codes_agree(monkeypatch):
    t = textbytes.texts_of(pa.array(["some words of one text", "andere Wörter hier"]))
    a = langid.bundles(*langid.trigrams(t)[:3], 2, 128)
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (a == langid.bundles(*langid.trigrams(t)[:3], 2, 128)).all()


def test_query_held_out_accuracy(spark, documents):
    got = QUERIES["op4_language_hypervectors"](spark, SF_SMALL).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == documents.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "aaa bbb aba", "x"), (2, "ccc ddd cdc", "y"), (3, None, "x"), (4, "123 !", "y"), (5, "", None), (6, "aba", None), (None, "cdc", "y"), (6, "aba", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    model = langid.train(docs)
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in langid.predict(docs, model).collect()))
    assert got == [(0, "y", True), (1, "x", True), (2, "y", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "x", True), (6, "x", True)]
    empty = docs.limit(0)
    assert langid.train(empty) == {} and langid.predict(empty, {}).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_many_short_texts_take_bounded_memory():
    """10,000 rows in a slice once made count matrices and cosines of some 300 MB."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 5).tolist()).decode() for _ in range(300)]
    texts = textbytes.texts_of(pa.array([" ".join(rng.choice(words, 3)) for _ in range(10_000)]))
    row, index, grams, _ = langid.trigrams(texts)
    tracemalloc.start()
    got = langid.bundles(row, index, grams, len(texts), 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    vectors = langid.gram_vectors(grams, 256).astype(int)
    for r in (0, 1023, 1024, 9_999):
        assert (got[r] == vectors[index[row == r]].sum(0)).all()


def test_trigrams_of_a_slice_take_bounded_memory():
    """A slice of 1 MB once took 64-bit rows, numbers and starts for each character."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßñéсловK  "))
    texts = ["".join(rng.choice(letters, 2000)) for _ in range(450)]
    one = textbytes.texts_of(pa.array(texts))
    langid.trigrams(one)
    tracemalloc.start()
    row, index, grams, _ = langid.trigrams(one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 << 20
    own = ["".join(map(chr, g)) for g in grams[index[row == 7]]]
    text = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in texts[7]).split(" "))
    while "  " in text:
        text = text.replace("  ", " ")
    assert own == [text[i : i + 3] for i in range(len(text) - 2) if text[i + 1] != " "]
