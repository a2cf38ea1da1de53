"""Stacking as a stage, the fitted store, parity of fitted members."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabula.operators import cleaning
from tabula.plans import ensemble as ens
from tabula.plans import fixtures as fx
from tabula.plans import jobs
from tabula.plans.fitted import rows_digest
from tabula.plans.stacking import Stacking, StackingModel
from tabula.session import scratch_path
from tests.conftest import SF_SMALL

FEATURES = ["x_price", "x_month", "c_priority", "c_status"]
MEMBERS = {"f": ("RandomForestClassifier", {"n_estimators": 4, "max_depth": 4}), "a": ("AdaBoostClassifier", {"n_estimators": 2, "learning_rate": 0.5}, ["x_price", "c_status"])}


@pytest.fixture(scope="module")
def labelled(spark):
    return cleaning.label_targets(fx.train(spark, SF_SMALL)).withColumn("class", F.col("class").cast("double")).persist()


@pytest.fixture(scope="module")
def fitted(labelled):
    return Stacking(MEMBERS, FEATURES, k=2, target="predict_proba", meta=("RandomForestClassifier", {"n_estimators": 4, "max_depth": 4})).fit(labelled)


def rows(df, *cols):
    return sorted(map(tuple, df.select("id", *cols).collect()))


def test_a_saved_stage_predicts_the_same(spark, labelled, fitted):
    path = scratch_path(spark, "stack")
    PipelineModel([fitted]).write().save(path)
    loaded = PipelineModel.load(path).stages[0]
    assert isinstance(loaded, StackingModel) and loaded.uid == fitted.uid and loaded.getOrDefault("target") == "predict_proba"
    cols = ["prediction", *fitted.meta_columns()]
    got = fitted.transform(labelled)
    assert rows(loaded.transform(labelled), *cols) == rows(got, *cols)
    assert got.where("prediction = class").count() > 0.6 * labelled.count() and set(labelled.columns) <= set(got.columns)


def test_an_unfitted_stage_keeps_its_parameters(spark):
    path = scratch_path(spark, "stack-estimator")
    Pipeline(stages=[Stacking(MEMBERS, FEATURES, k=3, target="predict_proba", passthrough=False)]).write().save(path)
    stage = Pipeline.load(path).getStages()[0]
    assert stage.named_members() == {"f": (*MEMBERS["f"], FEATURES), "a": MEMBERS["a"]}
    assert (stage.getOrDefault("folds"), stage.getOrDefault("target"), stage.getOrDefault("passthrough")) == (3, "predict_proba", False)
    with pytest.raises(ValueError):
        Stacking(MEMBERS, FEATURES, target="decision")


def test_meta_features_are_probabilities_of_members_that_never_saw_the_row(labelled):
    stage = Stacking({"f": MEMBERS["f"]}, FEATURES, k=2, target="predict_proba")
    out = stage.out_of_fold(labelled)
    assert out.count() == labelled.count() and out.where("m_f < 0 or m_f > 1 or m_f is null").isEmpty()
    # the same folds by hand: a fold's rows are scored by the model of the other fold
    from tabula.operators.folds import kfold_shuffled

    folded = kfold_shuffled(labelled, 2, "id").persist()
    want = []
    for i in range(2):
        model = ens.member_pipeline(labelled.schema, *MEMBERS["f"], FEATURES, "class").fit(folded.where(F.col("fold") != i))
        want += rows(model.transform(folded.where(F.col("fold") == i)).withColumn("p", vector_to_array("probability")[1]), "p")
    near = {k: v for k, v in want}
    got = rows(out, "m_f")
    assert len(got) == len(near) and sum(abs(v - near[k]) < 1e-9 for k, v in got) > 0.95 * len(got)


def test_members_without_probabilities_raise(labelled):
    with pytest.raises(ValueError, match="no probabilities"):
        Stacking({"r": ("RidgeClassifier", {"alpha": 1.0})}, FEATURES, k=2, target="predict_proba").fit(labelled)


@pytest.mark.parametrize(("method", "target", "meta"), [("soft", "predict_proba", None), ("stacking", "predict_proba", ("RandomForestClassifier", {"n_estimators": 4, "max_depth": 4}))])
def test_a_second_prediction_fits_nothing(spark, monkeypatch, method, target, meta):
    t = fx.train(spark, SF_SMALL)
    path = scratch_path(spark, "fitted")
    jobs.save_ensemble(spark, path, MEMBERS, {"f": 0.6, "a": 0.4}, FEATURES, t.schema, method, target, meta)
    assert jobs.ensemble_decision(spark, path) == (method, target, meta)
    first = rows(jobs.predict_job(spark, t, t.drop("class"), path, scratch_path(spark, "p1")), "class")

    def refuse(*args, **kwargs):
        raise AssertionError("fitted again")

    with monkeypatch.context() as m:
        m.setattr(ens, "fit_members", refuse)
        m.setattr(Stacking, "_fit", refuse)
        assert rows(jobs.predict_job(spark, t.repartition(3), t.drop("class"), path, scratch_path(spark, "p2")), "class") == first
        with pytest.raises(AssertionError, match="fitted again"):  # other training rows, other models
            jobs.predict_job(spark, t.where("id % 2 = 0"), t.drop("class"), path, scratch_path(spark, "p3"))


def test_digest_of_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (2, "a", None)], "k long, x string, y string")
    base = rows_digest(df)
    assert rows_digest(df.repartition(3).select("y", "k", "x")) == base
    swapped = df.select("k", F.col("y").alias("x"), F.col("x").alias("y"))
    others = [swapped, df.distinct(), df.limit(0), df.withColumn("k", F.col("k").cast("int")), df.withColumnRenamed("x", "z"), df.withColumn("y", F.lit(""))]
    assert len({base, *map(rows_digest, others)}) == len(others) + 1


def test_build_with_a_meta_model_is_not_optimised(spark):
    out = scratch_path(spark, "build")
    results = spark.createDataFrame([("f", 0.7, '{"n_estimators": 3, "max_depth": 3}', "RandomForestClassifier"), ("g", 0.6, '{"n_estimators": 3, "max_depth": 2}', "RandomForestClassifier")], "name string, score double, params string, model string")
    t = fx.train(spark, SF_SMALL)
    scores = jobs.ensemble_job(spark, t, results, ["f", "g"], FEATURES, out, sample_fraction=0.5, n_cv=2, run="r1", meta_model=("LogisticRegression", {}))
    assert scores.count() == 0
    assert jobs.ensemble_decision(spark, f"{out}/ensemble_r1") == ("stacking", "predict", ("LogisticRegression", {}))
    assert set(jobs.load_ensemble(spark, f"{out}/ensemble_r1")[0]) == {"f", "g"}


def test_fitted_members_predict_alike_inside_and_alone(spark, labelled):
    got = jobs.fitted_parity(labelled, MEMBERS, FEATURES, scratch_path(spark, "parity")).collect()
    assert {(r.model, r.n, r.mismatches) for r in got} == {(m, labelled.count(), 0) for m in MEMBERS}


def small(spark):
    made = [(i, float(i * 37 % 101), float(i % 12), f"c{i % 3}", None if i % 5 == 0 else "abc"[i % 4 % 3], float((i * 37 % 101 > 50) != (i % 9 == 0))) for i in range(240)]
    return spark.createDataFrame(made, "id long, x_price double, x_month double, c_priority string, c_status string, class double")


TREES = {"f": ("RandomForestClassifier", {"n_estimators": 2, "max_depth": 3}), "l": ("LGBMClassifier", {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3})}


def test_members_share_folds_and_encodings(spark, monkeypatch):
    """Each member's cross-validation once dealt the folds and fitted the preprocessing by itself."""
    df, made = small(spark), []
    members = {**TREES, "r": ("RidgeClassifier", {"alpha": 1.0})}
    alone = {n: jobs.cv_objective(df, m[0], [m[1]], FEATURES, "class", n_cv=3)[0] for n, m in members.items()}
    build = jobs.pp.build_preprocessing
    monkeypatch.setattr(jobs.pp, "build_preprocessing", lambda *a, **k: made.append(1) or build(*a, **k))
    assert jobs.members_cv_accuracy(df, members, FEATURES, "class", n_cv=3) == pytest.approx(alone)
    assert len(made) == 3


def test_compared_ensembles_fit_the_voting_members_once(spark, monkeypatch):
    fits, fit = [], ens.fit_members
    monkeypatch.setattr(ens, "fit_members", lambda *a, **k: fits.append(1) or fit(*a, **k))
    got = {r.model: r.score for r in ens.compare_ensembles(small(spark), TREES, FEATURES, "class", k=2, inner_k=2).collect()}
    assert set(got) == {"soft_voting", "stacking"} and len(fits) == 2 * (1 + 2)  # the stacked members were fitted again: 8


def test_loaded_pipelines_share_one_encoding(spark):
    df, path = small(spark), scratch_path(spark, "ensemble")
    jobs.save_ensemble(spark, path, TREES, {"f": 0.5, "l": 0.5}, FEATURES, df.schema)
    pipes = jobs.load_ensemble(spark, path)[3]
    together = ens.fit_pipelines(pipes, df, "class")
    assert together["f"].stages[0] is together["l"].stages[0]
    for n, p in pipes.items():
        assert rows(together[n].transform(df), "prediction") == rows(p.fit(df).transform(df), "prediction")
