import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabula.operators import preprocess as pp
from tabula.operators import vocabulary as voc
from tabula.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_vocabulary_is_ranked_per_column(spark):
    rows = [("b", "x"), (None, "x"), ("a", None), ("B", "é"), ("b", "z"), ("", "x")]
    got = {tuple(r) for r in voc.vocabulary(spark.createDataFrame(rows, "p string, q string"), ["p", "q"]).collect()}
    want = {(c, i, v) for c, k in (("p", 0), ("q", 1)) for i, v in enumerate(sorted({r[k] if r[k] is not None else "dna" for r in rows}, key=str.encode))}
    assert got == want
    assert voc.vocabulary(spark.createDataFrame([], "p string"), ["p"]).count() == 0


def test_no_label_reaches_the_driver_or_the_plan(spark):
    df = spark.range(50_000).select(F.concat(F.lit("v"), F.md5(F.col("id").cast("string"))).alias("c"))
    got = voc.vocabulary(df, ["c"])
    assert len(got._jdf.queryExecution().optimizedPlan().treeString()) < 30_000
    r = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    assert (r.n, r.d, r.lo, r.hi) == (50_000, 50_000, 0, 49_999)


def test_vectors_equal_the_pipeline(spark):
    t = fx.train(spark, SF_SMALL)
    num, cat = ["x_price", "x_month"], ["c_priority", "c_status"]
    fit_rows, rows = t.where("id % 3 > 0"), t
    pipe = pp.build_preprocessing(fit_rows.schema, features_in=num + cat).fit(fit_rows)
    want = pipe.transform(rows).select("id", vector_to_array("features").alias("x")).orderBy("id").toPandas()
    scaled = pipe.stages[0].transform(rows)
    got = voc.assemble(scaled, voc.vocabulary(fit_rows, cat), [f"{c}_scaled" for c in num], cat)
    got = got.select("id", vector_to_array("features").alias("x")).orderBy("id").toPandas()
    assert got["id"].tolist() == want["id"].tolist()
    assert np.allclose(np.vstack(got["x"].to_numpy()), np.vstack(want["x"].to_numpy()))


def test_wide_vocabulary_and_a_frequent_value(spark, monkeypatch):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("c"), F.lit(2.0).alias("x"))
    vocab = voc.vocabulary(df, ["c"])
    for most in (voc.BROADCAST_ROWS, 10):
        monkeypatch.setattr(voc, "BROADCAST_ROWS", most)
        got = voc.assemble(df, vocab, ["x"], ["c"])
        some = {r.id: r.features for r in got.where("id < 9").collect()}
        assert got.count() == n and all(v.size == 2 * n // 3 + 1 for v in some.values())
        # 'often' is the least value, so it has no place
        assert some[3].indices.tolist() == [0] and len(some[4].indices) == 2 and some[4].values.tolist() == [2.0, 1.0]
    unseen = spark.createDataFrame([(1, "never", None)], "id long, c string, x double")
    v = voc.assemble(unseen, vocab, ["x"], ["c"]).first().features
    assert v.indices.tolist() == [0] and np.isnan(v.values[0])
