import numpy as np
import pyarrow as pa
import pytest

from tabula.llm import textbytes as tb
from tabula.llm import toxicity as tx
from tabula.llm.queries import QUERIES
from tests.conftest import SF_MID


def word_lexicon(**weights):
    units = tx._units(pa.array(list(weights)))[0][:, 0]
    order = np.argsort(units)
    return tx.Lexicon(units[order], np.array(list(weights.values()), float)[order])


LEXICON = word_lexicon(dork=6.0, silly=2.0)


def labels(text):
    """Labels and weights of the clauses' sums by label."""
    x = tx.features(tx._lowered(pa.array([text])), LEXICON)[0]
    return {tx.LABELS[k]: round(float(np.expm1(v)), 6) for k, v in enumerate(x[3:]) if v}


PLAIN, MILD, THREAT = (tx._INSULT, False, False, False), (tx._MILD, False, False, False), (tx._THREAT, False, False, False)


def with_(label, **marks):
    out = dict(zip(("kind", "denied", "told", "addressed"), label, strict=True)) | marks
    return tuple(out.values())


@pytest.mark.parametrize(
    "text,want",
    [
        (None, {}), ("", {}), ("nothing here. Not you!", {}),
        ("What a Dork.", {PLAIN: 6.0}), ("silly thing", {MILD: 2.0}), ("silly dork", {PLAIN: 8.0}), ("silly, silly", {with_(MILD, kind=tx._INSULT): 4.0}),
        ("You dork!", {with_(PLAIN, addressed=True): 6.0}), ("a dork, that's you", {with_(PLAIN, addressed=True): 6.0}),
        ("You left. A dork came.", {PLAIN: 6.0}), ("you a b c d e f g h i j dork", {PLAIN: 6.0}),
        ("he is not a dork", {with_(PLAIN, denied=True, addressed=True): 6.0}), ("not a b c d e f g h i j dork", {PLAIN: 6.0}),
        ("she said dork", {with_(PLAIN, told=True, addressed=True): 6.0}), ('the word "dork" is old', {with_(PLAIN, told=True): 6.0}), ("« dork » dork", {PLAIN: 12.0}), ('"', {}),
        ("I will kill him", {with_(THREAT, addressed=True): tx.SEED_WEIGHT}), ("to kill time", {}), ("will not kill", {with_(THREAT, denied=True): tx.SEED_WEIGHT}),
        ("dork. dork", {PLAIN: 12.0}), ("dork you. dork", {PLAIN: 6.0, with_(PLAIN, addressed=True): 6.0}), ("DORK### $$dork", {PLAIN: 12.0}),
    ],
)
def test_clause_labels(text, want):
    assert labels(text) == want


def test_rows_and_slices_dont_mix():
    texts = ["you", "dork", None, 'say "', "dork", "x. " * 50 + "dork", ""]
    whole = tx.features(tx._lowered(pa.array(texts, pa.string())), LEXICON)
    alone = np.concatenate([tx.features(tx._lowered(pa.array([t], pa.string())), LEXICON) for t in texts])
    assert np.allclose(whole, alone)
    many = list(tb.slices(tx._lowered(pa.array(texts * 40, pa.string())), 64))
    assert len(many) > 9 and np.allclose(np.concatenate([tx.features(t, LEXICON) for _, _, t in many]), np.tile(whole, (40, 1)))


def test_long_clause():
    x = tx.features(tx._lowered(pa.array(["you dork not " * 20_000])), LEXICON)
    assert np.isclose(np.expm1(x[0, 2]), 120_000)


def docs_and_labels(spark, n=600):
    rng = np.random.default_rng(2)
    common = [f"{a}{b}" for a in "ka lo mi ne ru".split() for b in "ta so pi de gu ho".split()]
    rows, marks = [], []
    for k in range(n):
        words = list(rng.choice(common, 40))
        if k % 6 == 0:  # three stems with many endings, and a word
            for at in rng.integers(0, 40, 3):
                words[at] = rng.choice(["grubb", "snork"]) + rng.choice(list("abcdefgh"))
            words[rng.integers(40)] = "quirz"
        rows.append((k, " ".join(words) + ".", "clash"))
        marks.append((k, int(k % 6 == 0)))
    marks += [(None, 1), (3, None), (7, 1), (7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_learned_words_and_stems(spark):
    docs, marks = docs_and_labels(spark)
    model = tx.train(docs, marks.where("doc_id % 3 <> 1"))
    units = tx._units(pa.array(["quirz", "grubbz", "snorkk", "quirky", "kata", "grub"]))
    weight = np.where(units[1], model.lexicon.of(units[0]), 0).max(1)
    assert (weight[:3] > 2).all() and (weight[3:] == 0).all()
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "lota grubbx. quirz", "x"), (-3, "lota grubbx. quirz", "x"), (None, "mide " * 100_000, "x")], docs.schema)
    got = tx.score(docs.unionByName(odd), model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id >= 0:
            assert (r.score >= 0.7) == (r.doc_id % 6 == 0)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[-1] == by_id[-2] < 0.3 and by_id[-3] > 0.7 and by_id[None] < 0.7
    assert tx.score(docs.limit(0), model).count() == 0


def test_copies_teach_once(spark):
    docs, marks = docs_and_labels(spark, 240)
    text = "an unusual harmless sentence with zebras and giraffes among plenty other animals of distant countries and wide grasslands quirz"
    copies = spark.createDataFrame([(1000 + k, text + " " + "abcdefghij"[k % 10], "x") for k in range(60)], docs.schema)
    taught = marks.unionByName(spark.createDataFrame([(1000 + k, 1) for k in range(60)], marks.schema))
    model = tx.train(docs.unionByName(copies), taught)
    units = tx._units(pa.array(["zebras", "giraffes", "quirz"]))
    weight = np.where(units[1], model.lexicon.of(units[0]), 0).max(1)
    assert weight[0] == weight[1] == 0 and weight[2] > 2


def test_without_labels_the_seeds_remain(spark):
    docs, marks = docs_and_labels(spark, 30)
    for none in (marks.limit(0), marks.where("toxic = 0")):
        model = tx.train(docs, none)
        seeded = spark.createDataFrame([(1, "you idiot", "x"), (2, "a fine day", "x")], docs.schema)
        a, b = (r.score for r in tx.score(seeded, model).orderBy("doc_id").collect())
        assert a > b and b < 0.1


def test_query_on_held_out_documents(spark):
    got = QUERIES["op12_toxicity_grammar"](spark, SF_MID)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    marks = spark.read.parquet(f"{SF_MID}/labels.parquet")
    english = spark.read.parquet(f"{SF_MID}/documents.parquet").where("lang = 'en'")
    rows = got.join(marks, "doc_id").join(english, "doc_id").where("held_out").select("predicted", "toxic").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    assert got.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
