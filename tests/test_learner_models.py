"""Learners whose models are tables: AdaBoost nodes, k-NN references; saved, loaded, voting softly."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabula.operators import boosting, learners, lsh
from tabula.plans import ensemble as ens
from tabula.plans import fixtures as fx
from tabula.plans import jobs
from tabula.session import scratch_path
from tests.conftest import SF_SMALL

FEATURES = ["x_price", "x_month", "c_priority", "c_status"]


def points(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(float)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)


def labelled(spark):
    from tabula.operators import cleaning

    return cleaning.label_targets(fx.train(spark, SF_SMALL)).withColumn("class", F.col("class").cast("double"))


def test_flat_tree_equals_the_tree(spark):
    """Thresholds, and categories of one-hot columns, which carry nominal metadata."""
    t = labelled(spark)
    pipe = ens.member_pipeline(t.schema, "RandomForestClassifier", {}, FEATURES, "class")
    encoded = pipe.fit(t).transform(t).select("id", "class", "features").drop("prediction")
    for depth in (1, 4, 7):
        tree = DecisionTreeClassifier(labelCol="class", maxDepth=depth, seed=1).fit(encoded)
        row = boosting.tree_row(0, 1.0, tree)
        table = boosting.NodeTable([row])
        assert table.depth == tree.depth and len(row[2]) == tree.numNodes
        got = tree.transform(encoded).select(vector_to_array("features").alias("x"), "prediction").toPandas()
        margin = table.margin(np.vstack(got["x"].to_numpy()))
        assert ((margin > 0) == (got["prediction"] > 0)).all()
    assert any(c is not None for c in row[4])


def test_adaboost_learns_and_survives_saving(spark):
    df = points(spark)
    model = boosting.AdaBoostSAMME(rounds=8, learningRate=0.8, maxDepth=2).fit(df)
    out = model.transform(df).select("id", "label", "rawPrediction", vector_to_array("probability").alias("p"), "prediction").orderBy("id").toPandas()
    assert (out["prediction"] == out["label"]).mean() > 0.85
    assert np.allclose(out["p"].str[1], 1 / (1 + np.exp(-2 * out["rawPrediction"]))) and np.allclose(out["p"].str[0] + out["p"].str[1], 1)
    assert ((out["p"].str[1] > 0.5) == (out["prediction"] > 0)).all()
    # the vote is the weighted mean of the trees' votes
    table = boosting.NodeTable(model.rows)
    x = np.vstack(df.orderBy("id").select(vector_to_array("features").alias("x")).toPandas()["x"].to_numpy())
    votes = sum(r[1] * (2 * (boosting.NodeTable([r]).margin(x) > 0) - 1) for r in model.rows) / sum(r[1] for r in model.rows)
    assert np.allclose(votes, table.margin(x)) and np.allclose(votes, out["rawPrediction"])
    path = scratch_path(spark, "ada")
    PipelineModel([model]).write().save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].uid == model.uid and again.stages[0].rows == model.rows
    assert again.transform(df).select("id", "prediction", "rawPrediction").exceptAll(model.transform(df).select("id", "prediction", "rawPrediction")).count() == 0
    assert model.transform(df.limit(0)).count() == 0


def test_plan_of_a_prediction_is_independent_of_the_rounds(spark):
    df = points(spark, 120)
    rows = boosting.AdaBoostSAMME(rounds=1, maxDepth=1).fit(df).rows
    plans = [boosting.AdaBoostSAMMEModel(rows * n).transform(df)._jdf.queryExecution().optimizedPlan().treeString().count("\n") for n in (1, 300)]
    assert plans[0] == plans[1]


def test_knn_model_probabilities_and_saving(spark):
    df = points(spark, 200)
    est = learners.KNNCosineClassifier(k=5, weights="distance")
    model = est.fit(df.where("id >= 40"))
    out = model.transform(df.where("id < 40")).select("id", vector_to_array("probability").alias("p"), "prediction").toPandas()
    assert len(out) == 40 and ((out["p"].str[1] > 0.5) == (out["prediction"] > 0)).all()
    near = learners.knn_cosine(df.where("id < 40").select("id", vector_to_array("features").alias("vec")), model.refs, 5).toPandas()
    for r in out.itertuples():
        own = near[near.qid == r.id]
        w = 1 / np.maximum(1e-12, 1 - own.sim)
        assert np.isclose(r.p[1], w[own.label > 0].sum() / w.sum())
    path = scratch_path(spark, "knn")
    PipelineModel([model]).write().save(path)
    again = PipelineModel.load(path)
    assert again.transform(df).select("id", "prediction").exceptAll(model.transform(df).select("id", "prediction")).count() == 0
    est_path = scratch_path(spark, "knn-est")
    est.write().save(est_path)
    assert learners.KNNCosineClassifier.load(est_path).getOrDefault("k") == 5


def clustered(spark, n, seed, first=0, d=24):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(60, d))
    which = rng.integers(0, 60, n)
    x = centres[which] + rng.normal(size=(n, d)) * 0.15
    return spark.createDataFrame([(first + i, v.tolist(), int(c % 2)) for i, (v, c) in enumerate(zip(x, which, strict=True))], "id long, vec array<double>, label int")


def test_hashed_neighbours_have_recall_and_save_pairs(spark):
    refs, queries = clustered(spark, 3000, 1), clustered(spark, 500, 2, 10_000)
    found = lsh.knn_cosine_lsh(queries, refs, 5).persist()
    assert found.groupBy("qid").count().where("count = 5").count() == 500
    assert lsh.lsh_recall(found, queries, refs, 5, share=1) >= 0.95
    assert lsh.lsh_candidates(queries, refs).count() < 0.25 * 3000 * 500
    wrong = found.join(learners.knn_cosine(queries, refs, 50).select("qid", "rid", F.col("sim").alias("exact")), ["qid", "rid"]).where("abs(sim - exact) > 1e-9")
    assert wrong.count() == 0


def test_queries_that_meet_nobody_are_searched_exactly(spark):
    refs = spark.createDataFrame([(i, [1.0, 0.01 * i], i % 2) for i in range(20)] + [(90, [0.0, 0.0], 1), (91, None, 0)], "id long, vec array<double>, label int")
    queries = spark.createDataFrame([(100, [-1.0, 0.3], 0), (101, [1.0, 0.05], 0)], "id long, vec array<double>, label int")
    got = lsh.knn_cosine_lsh(queries, refs.where("vec is not null"), 3, bands=2, width=2).select("qid", "rid")
    want = learners.knn_cosine(queries, refs.where("vec is not null"), 3).select("qid", "rid")
    assert sorted(map(tuple, got.where("qid = 100").collect())) == sorted(map(tuple, want.where("qid = 100").collect()))
    assert got.where("qid = 101").count() == 3
    assert lsh.knn_cosine_lsh(queries, refs.limit(0), 3).count() == 0


@pytest.mark.parametrize("method", ["hard", "soft"])
def test_an_ensemble_with_adaboost_and_knn_saves_loads_and_votes(spark, method):
    t = fx.train(spark, SF_SMALL)
    members = {
        "a": ("AdaBoostClassifier", {"n_estimators": 3, "learning_rate": 0.5}),
        "k": ("KNeighborsClassifier", {"n_neighbors": 5, "weights": "uniform"}),
        "f": ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4}),
    }
    path = scratch_path(spark, "ensemble-tables")
    jobs.save_ensemble(spark, path, members, {"a": 0.4, "k": 0.3, "f": 0.3}, FEATURES, t.schema, method=method)
    loaded, weights, _, pipes = jobs.load_ensemble(spark, path)
    assert set(loaded) == set(members) and weights["a"] == 0.4 and len(pipes["a"].getStages()) == len(pipes["k"].getStages())
    out = jobs.predict_job(spark, t, t.drop("class"), path, scratch_path(spark, "predictions"))
    both = out.withColumnRenamed("class", "p").join(t, "id")
    assert out.count() == t.count() and both.where("p = class").count() > 0.6 * t.count()
