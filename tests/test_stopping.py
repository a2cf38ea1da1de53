import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabula.operators.learners import make_learner
from tabula.operators.stopping import StoppedBoostedTrees, best_count
from tabula.session import scratch_path


def test_best_count():
    assert best_count([5, 4, 3, 2], 1) == 4
    assert best_count([5, 3, 4, 4, 1], 2) == 2
    assert best_count([5, 3, 4, 4, 1], 3) == 5
    assert best_count([1, 1, 1], 5) == 1
    assert best_count([2], 1) == 1


def noisy(spark, n=1500, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] + x[:, 1] > 0.6) ^ (rng.random(n) < 0.25)).astype(float)
    rows = [(i, *map(float, v), float(t), float(v[0] + v[1] > 0.6)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, truth double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).persist()


def test_stops_where_the_held_out_loss_is_least(spark):
    df = noisy(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    params = {"iterations": 14, "depth": 5, "learning_rate": 0.6}
    est = make_learner("CatBoostClassifier", params | {"od_wait": 3})
    assert isinstance(est, StoppedBoostedTrees)
    path = scratch_path(spark, "stopped")
    est.write().save(path)
    assert StoppedBoostedTrees.load(path).getOrDefault("wait") == 3
    model = est.fit(train)
    whole = make_learner("CatBoostClassifier", params).fit(train)
    held = train.where(est.held_out(train)).withColumn("__weight", F.lit(1.0))
    assert 0 < held.count() < 0.2 * train.count()
    losses = est._trees(14).fit(train.where(~est.held_out(train)).withColumn("__weight", F.lit(1.0))).evaluateEachIteration(held)
    assert model.getNumTrees == best_count(losses, 3) < whole.getNumTrees == 14

    def right(m):
        return m.transform(test).agg(F.avg((F.col("prediction") == F.col("truth")).cast("double"))).first()[0]

    assert right(model) > 0.8 and right(model) >= right(whole) - 0.02


def test_class_weight_moves_predictions(spark):
    df = noisy(spark, 800)
    params = {"iterations": 5, "depth": 3, "learning_rate": 0.3}
    ones = [make_learner("CatBoostClassifier", params | {"scale_pos_weight": w}).fit(df).transform(df).agg(F.sum("prediction")).first()[0] for w in (1.0, 6.0)]
    assert ones[1] > 1.2 * ones[0]
