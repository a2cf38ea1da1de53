import numpy as np
from pyspark.sql import functions as F

from tabula.llm import mixing
from tabula.llm.queries import MIX_SHARE, MIX_TARGETS, QUERIES
from tests.conftest import SF_SMALL


def test_raked_marginals_and_calibration():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, 24).astype(float)
    places = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [np.array(t) for t in ([0.1, 0.2, 0.3, 0.4], [0.5, 0.3, 0.2], [0.25, 0.75])]
    w = mixing.rake(tokens, places, targets)
    for p, t in zip(places, targets):
        assert np.allclose(np.bincount(p, w), t, atol=1e-9)
    for budget in (0.01, 0.3, 0.9, 1.0):
        p = mixing.calibrate(tokens, w, budget * tokens.sum())
        assert (p <= 1).all() and abs((p * tokens).sum() - budget * tokens.sum()) < 1e-6 * tokens.sum()


def test_missing_values_and_empty_cells():
    w = mixing.rake(np.array([5.0, 5.0]), [np.array([0, 1])], [np.array([0.2, 0.2, 0.6])])
    assert np.allclose(w, [0.5, 0.5])
    assert mixing.rake(np.zeros(2), [np.array([0, 1])], [np.array([0.5, 0.5])]).tolist() == [0, 0]
    assert mixing.calibrate(np.zeros(2), np.zeros(2), 0).tolist() == [0, 0]


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (None, "c d e", None), (1, "a b", "x"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix", F.lit(1)).withColumn("tokens", F.lit("t"))
    got = mixing.mix(docs, {"source": F.col("source")}, {"source": {"x": 0.5}}, 1.0)
    assert got.columns == ["doc_id", "text", "source", "tokens", "mix"] and got.count() == 5
    assert {(r.doc_id, r.mix.source, r.mix.tokens) for r in got.collect()} == {(1, "x", 2), (2, "*", 0), (None, "*", 3), (4, "*", 0)}
    assert mixing.mix(docs.limit(0), {"source": F.col("source")}, {"source": {"x": 1.0}}, 0.5).collect() == []


def test_drawn_tokens_meet_the_targets(spark):
    got = QUERIES["op5_raked_mixture"](spark, SF_SMALL.replace("0.001", "0.1")).toPandas()
    drawn = (got.tokens * got.probability)
    assert abs(drawn.sum() / got.tokens.sum() - MIX_SHARE) < 0.01
    if got.probability.max() < 1:
        for lang, share in MIX_TARGETS["lang"].items():
            assert abs(drawn[got.lang == lang].sum() / drawn.sum() - share) < 0.05
    assert abs(got[got.drawn].tokens.sum() / got.tokens.sum() - MIX_SHARE) < 0.05
