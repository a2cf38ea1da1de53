"""Reference unit tests restated, plus operator properties against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabula.operators import candidates, cleaning, folds, learners, metrics, vote
from tabula.operators import preprocess as pp
from tabula.operators.rowindex import with_row_index
from tabula.plans import fixtures as fx
from tabula.plans import search
from tabula.session import scratch_path
from tabula.sources import csv as csvio
from tabula.sources import store
from tests.conftest import SF_MID, SF_SMALL


# ------------------------------------------------------------ restated reference tests
def test_one_hot_width_on_inline_frame(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "b", "aa"), (3, "c", "aa"), (4, "d", "bb"), (5, "e", "bb")], "col1 bigint, col2 string, col3 string"
    )
    model = pp.build_preprocessing(df.schema).fit(df)
    out = model.transform(df)
    width = len(out.select("features").first()[0])
    assert width == 1 + (5 - 1) + (3 - 1)


@pytest.mark.parametrize(
    "model,expected",
    [("RidgeClassifier", False), ("KNeighborsClassifier", False), ("SVC", False), ("LGBMClassifier", False),
     ("RandomForestClassifier", False), (None, False)],
)
def test_strings_allowed_rule(model, expected):
    assert pp.strings_allowed(model, None) is expected


def test_numeric_model_with_strings_raises():
    with pytest.raises(ValueError):
        pp.strings_allowed("XGBClassifier", True)


def test_passthrough_keeps_column_count(spark):
    t = folds.head_fraction(fx.train(spark, SF_SMALL).drop("class"), 0.12, ["id"])
    feats = ["x_price", "x_month", "c_priority", "c_status"]
    out = pp.build_preprocessing(t.schema, features_in=feats, allow_strings=True).fit(t).transform(t)
    assert len(out.columns) == len(feats)


# ------------------------------------------------------------ folds and row index
def test_row_index_is_a_permutation(spark):
    t = fx.train(spark, SF_MID).select("id")
    r = with_row_index(t, ["id"], "rn").toPandas().sort_values("id")
    assert list(r["rn"]) == list(range(len(r)))


def test_group_row_index_skewed_group(spark):
    # one event type is forced to hold every row: the index must still be exact
    ev = fx.table(spark, SF_MID, "events").select("event_id", F.lit("hot").alias("g"))
    r = with_row_index(ev, ["event_id"], "rn", group_cols=["g"]).toPandas().sort_values("event_id")
    assert list(r["rn"]) == list(range(len(r)))


@pytest.mark.parametrize("k", [2, 3, 5, 7])
def test_contiguous_folds_sizes(spark, k):
    t = fx.train(spark, SF_SMALL).select("id")
    f = folds.kfold_contiguous(t, k, ["id"]).toPandas().sort_values("id")
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == k
    assert f["fold"].is_monotonic_increasing


def _stratified_by_positions(labels, k):
    """Fold of each row: a class takes the next positions, fold i as many of its rows as there
    are positions p with p mod k = i, in blocks."""
    rows_of = {}
    for row, label in enumerate(labels):
        rows_of.setdefault(label, []).append(row)
    fold, start = [None] * len(labels), 0
    for rows in rows_of.values():
        positions = range(start, start + len(rows))
        blocks = [i for i in range(k) for p in positions if p % k == i]
        for row, i in zip(rows, blocks, strict=True):
            fold[row] = i
        start += len(rows)
    return fold


@pytest.mark.parametrize("k", [2, 5, 7])
def test_stratified_folds_by_positions(spark, k, monkeypatch):
    t = fx.train(spark, SF_SMALL).select("id", "class")
    many = t.select("id", (F.col("id") * 7919 % 5).cast("int").alias("class"), F.lit("clash").alias("__g"))
    few = spark.createDataFrame([(3, None), (1, "z"), (2, "a"), (9, None)], "id long, class string")
    for df in (t, many, few):
        rows = df.orderBy("id").collect()
        want = _stratified_by_positions([r["class"] for r in rows], k)
        for most in (folds.MAX_CLASSES, 1):  # by literal keys, and by ranks
            monkeypatch.setattr(folds, "MAX_CLASSES", most)
            got = folds.kfold_stratified(df, k, "class", ["id"])
            assert got.columns == [*df.columns, "fold"]
            assert [r.fold for r in got.orderBy("id").collect()] == want
            monkeypatch.undo()


# ------------------------------------------------------------ votes
def _brute_subset_scores(pdf, models, weights):
    out = {}
    for r in range(1, len(models) + 1):
        for combo in itertools.combinations(range(len(models)), r):
            for fold, g in pdf.groupby("fold"):
                hits = 0
                for _, row in g.iterrows():
                    mass = {}
                    for j in combo:
                        mass[row[models[j]]] = mass.get(row[models[j]], 0.0) + weights[j]
                    best = sorted(mass.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
                    hits += best == row["y"]
                out[("-".join(models[j] for j in combo), fold)] = hits / len(g)
    return out


def test_subset_scores_equal_brute_force(spark):
    p = fx.pred(spark, SF_SMALL)
    w = [0.4, 0.1, 0.3, 0.2]
    got = vote.subset_scores(p, fx.RULE_MODELS, w, "y").toPandas()
    exp = _brute_subset_scores(p.toPandas(), list(fx.RULE_MODELS), w)
    assert len(got) == len(exp)
    for _, r in got.iterrows():
        assert math.isclose(r["score"], exp[(r["combination"], r["fold"])], abs_tol=1e-12)


def test_vote_invariant_to_partitioning(spark):
    p = fx.pred(spark, SF_SMALL)
    w = {"p1": 0.4, "p2": 0.1, "p3": 0.3, "p4": 0.2}
    a = sorted(vote.vote_hard(p, w).collect())
    b = sorted(vote.vote_hard(p.repartition(3), w).collect())
    assert a == b


def test_soft_vote_single_model_is_argmax(spark):
    pr = fx.proba(spark, SF_SMALL).select("id", vote.binary_proba_array(F.col("a")).alias("a"))
    v = vote.vote_soft(pr, {"a": 1.0}).join(pr.select("id", vote.argmax_label(F.col("a")).alias("am")), "id")
    assert v.where("prediction <> am").count() == 0


def test_hard_vote_ties_go_to_smallest_label(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 2, 1)], "id long, m1 int, m2 int")
    got = dict((r["id"], r["prediction"]) for r in vote.vote_hard(df, {"m1": 0.5, "m2": 0.5}).collect())
    assert got == {1: 0, 2: 0, 3: 1}


# ------------------------------------------------------------ search state
def _sequential_patience(values, m):
    best, cnt = None, 0
    for v in values:
        if best is None or (v is not None and v > best * (1 + m)):
            best, cnt = v, 0
        elif v is not None:
            cnt += 1
    return best, cnt


def test_patience_state_equals_sequential_fold(spark):
    tr = fx.trials(spark, SF_SMALL)
    got = {r["study"]: (r["best_value"], r["no_improvement_count"]) for r in search.patience_state(tr, 0.05).collect()}
    pdf = tr.toPandas().sort_values(["study", "number"])
    for study, g in pdf.groupby("study"):
        vals = [None if pd.isna(v) else float(v) for v in g["value"]]
        assert got[study] == _sequential_patience(vals, 0.05)


# ------------------------------------------------------------ learners
def test_ridge_equals_numpy_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=300) > 0).astype(float)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y)], ["features", "label"])
    m = learners.RidgeClassifier(alpha=3.0).fit(df)
    xc, ys = x - x.mean(0), (2 * y - 1)
    w = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(3), xc.T @ (ys - ys.mean()))
    b = ys.mean() - x.mean(0) @ w
    assert np.allclose(m.getOrDefault("coefficients"), w, atol=1e-9)
    assert math.isclose(m.getOrDefault("intercept"), b, abs_tol=1e-9)


def test_knn_equals_brute_force(spark):
    e = fx.table(spark, SF_SMALL, "embeddings")
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    got = learners.knn_cosine(q, r, 3, query_blocks=2, ref_blocks=3).toPandas()
    qp, rp = q.toPandas(), r.toPandas()
    qm, rm = np.vstack(qp["vec"]).astype(float), np.vstack(rp["vec"]).astype(float)
    sims = (qm @ rm.T) / np.outer(np.linalg.norm(qm, axis=1), np.linalg.norm(rm, axis=1))
    for i, qid in enumerate(qp["id"]):
        order = np.lexsort((rp["id"].to_numpy(), -sims[i]))[:3]
        exp = list(rp["id"].to_numpy()[order])
        assert list(got[got.qid == qid].sort_values("rank")["rid"]) == exp


def test_learners_beat_majority_rate(spark):
    from tabula.plans import catalog

    for name in ("gbt_classify", "random_forest", "linear_svc", "adaboost_samme", "stacking_predict"):
        out = catalog.QUERIES[name](spark, SF_MID)
        acc = out.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        major = out.select(F.avg("label")).first()[0]
        assert acc > max(major, 1 - major) + 0.02, name


def test_train_statistics_never_see_test_rows(spark):
    t = fx.train(spark, SF_SMALL).select("id", "x_price", "x_month")
    fit_rows, apply_rows = t.where("id % 2 = 0"), t.where("id % 2 = 1")
    m = pp.PopulationScaler(inputCols=["x_month"], outputCols=["s"]).fit(fit_rows)
    exp = fit_rows.select(F.avg("x_month")).first()[0]
    assert math.isclose(m.getOrDefault("means")[0], exp)
    assert apply_rows.count() > 0


def test_clean_categorical_fit_on_train_applies_to_test(spark):
    ev = fx.table(spark, SF_SMALL, "events").select("event_id", "props")
    kept = cleaning.fit_category_filter(ev, ["props"])
    out = cleaning.clean_categorical(ev.limit(50), ["props"], fitted=kept)
    allowed = {r["value"] for r in kept.collect()} | {"dna"}
    assert {r["props"] for r in out.collect()} <= allowed


def test_metrics_accuracy_matches_pandas(spark):
    p = fx.pred(spark, SF_SMALL)
    got = {r["model"]: r["accuracy"] for r in metrics.model_accuracy(p, fx.RULE_MODELS, "y").collect()}
    pdf = p.toPandas()
    for m in fx.RULE_MODELS:
        assert math.isclose(got[m], (pdf[m] == pdf["y"]).mean())


def test_streaming_scoring_matches_batch(spark):
    from tabula.plans import ensemble as ens
    from tabula.session import scratch_path
    from tabula.streaming.scoring import read_scores, score_stream

    t = cleaning.engineer_features(fx.train(spark, SF_SMALL)).withColumn("class", F.col("class").cast("double"))
    feats = ["x_price", "x_month", "c_priority", "c_status"]
    members = {"RidgeClassifier_top_0": ("RidgeClassifier", {"alpha": 1.0})}
    models = ens.fit_members(t, members, feats, "class")
    src = scratch_path(spark, "stream-src")
    test_rows = t.drop("class")
    test_rows.write.parquet(src)
    out = scratch_path(spark, "stream-out")
    score_stream(spark, src, test_rows.schema, models, {"RidgeClassifier_top_0": 1.0}, out)
    streamed = read_scores(spark, out)
    batch = cleaning.unlabel_targets(ens.hard_vote_predict(models, test_rows, {"RidgeClassifier_top_0": 1.0}).withColumnRenamed("prediction", "class"))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_running_records_equal_sequential(spark):
    tr = fx.trials(spark, SF_SMALL)
    got = {(r["study"], r["number"]) for r in search.running_records(tr, bucket_rows=7).collect()}
    pdf = tr.toPandas().sort_values(["study", "number"])
    exp = set()
    for study, g in pdf.groupby("study"):
        best = None
        for n, v in zip(g["number"], g["value"]):
            if pd.isna(v):
                continue
            if best is None or v > best:
                exp.add((study, n))
                best = v
    assert got == exp


# ------------------------------------------------------------ nothing is lost silently
def test_rows_without_a_label_keep_a_fold(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"))
    out = folds.kfold_stratified(df, 4, "y", ["id"]).toPandas()
    assert len(out) == 100 and out.groupby("fold").size().tolist() == [25] * 4
    assert out[out.y.isna()].groupby("fold").size().tolist() == [5] * 4


def test_text_keys_with_a_common_prefix_spread(spark):
    from tabula.operators import rowindex

    df = spark.range(3000).select(F.concat(F.lit("conversation-0000000000"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"))
    assert df.select(rowindex._text_bucket(df, "k", 8).alias("b")).distinct().count() == 8
    out = with_row_index(df.unionByName(spark.createDataFrame([(None,)], "k string")), ["k"], "rn").orderBy("rn").toPandas()
    assert out.rn.tolist() == list(range(3001)) and out.k[0] is None and out.k[1:].tolist() == sorted(out.k[1:])


def test_subsets_of_sixteen_models(spark):
    names = [f"m{j}" for j in range(16)]
    df = spark.createDataFrame([(0, 1, *[j % 2 for j in range(16)])], ["fold", "y", *names])
    out = vote.subset_scores(df, names, [1.0] * 16, "y")
    assert out.select("bitmap").distinct().count() == 2**16 - 1
    best = {r.bitmap: r.score for r in out.where("bitmap in (2, 1, 65535, 10)").collect()}
    assert best == {2: 1.0, 1: 0.0, 65535: 0.0, 10: 1.0}
    with pytest.raises(ValueError):
        vote.with_bitmaps(df, 63)


def test_patience_chain_has_no_round_limit(spark):
    trials = spark.range(40).select(F.lit("s").alias("study"), F.col("id").alias("number"), F.col("id").cast("double").alias("value"))
    assert search.best_chain(trials.where("number > 0"), 0.0, batch=2).count() == 39


def test_missing_selection_raises(spark):
    results = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, score double")
    assert store.select_results(results, ["a", "a"]).count() == 1
    with pytest.raises(ValueError, match="zz"):
        store.select_results(results, ["a", "zz"])


def test_runs_have_trials_of_their_own(spark):
    root = scratch_path(spark, "trials")
    batch = spark.createDataFrame([("s", 0, 0.5, "COMPLETE"), ("s", 1, 0.6, "COMPLETE")], "study string, seq long, value double, state string")
    store.append_trials(spark, root, batch, run="one")
    store.append_trials(spark, root, batch, run="two")
    store.append_trials(spark, root, batch, run="one")
    numbers = lambda run: sorted(r.number for r in store.read_trials(spark, root, run).collect())
    assert numbers("one") == [0, 1, 2, 3] and numbers("two") == [0, 1] and len(numbers(None)) == 6


def test_csv_dialect_round_trip(spark, tmp_path):
    import pandas as pd

    rows = [(1, 'a "q", b'), (2, "line\nbreak"), (3, "back\\slash"), (4, None), (5, " padded ")]
    path = scratch_path(spark, "dialect")
    csvio.write_csv(spark.createDataFrame(rows, "id long, s string").coalesce(1), path)
    assert sorted(tuple(r) for r in csvio.read_csv_table(spark, path, "id long, s string").collect()) == rows
    part = next(p for p in __import__("glob").glob(path.replace("file:", "") + "/part-*"))
    assert pd.read_csv(part).s.tolist()[:3] == [r[1] for r in rows[:3]]
    pd.DataFrame({"x": ["1.5", "NA", "2.5"], "t": ['say "hi", you', "two\nlines", "1d"]}).to_csv(tmp_path / "p.csv", index=False)
    got = csvio.read_csv_table(spark, f"file://{tmp_path}/p.csv")
    assert dict(got.dtypes) == {"x": "double", "t": "string"} and got.count() == 3


def test_only_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1d", "1"), ("2f", " 2.5e3"), ("3", None)], "a string, b string")
    assert dict(cleaning.coerce_numeric(df).dtypes) == {"a": "string", "b": "double"}


def test_models_by_feature_sets():
    sets = [candidates.FeatureSet("base", ("a", "b"), is_optional=False), candidates.FeatureSet("x", ("c",)), candidates.FeatureSet("y", ("b", "d"))]
    got = candidates.model_candidates(["M"], sets)
    assert got == {"M_base_": ("M", ["a", "b"]), "M_base_x_": ("M", ["a", "b", "c"]), "M_base_y_": ("M", ["a", "b", "d"]), "M_base_x_y_": ("M", ["a", "b", "c", "d"])}
    assert candidates.model_candidates(["M", "N"], ["a"]) == {"M_": ("M", ["a"]), "N_": ("N", ["a"])}


def test_improvement_by_direction():
    assert search.improves(0.5, None, 0.1) and not search.improves(None, 0.1, 0.1)
    assert search.improves(0.52, 0.5, 0.01) and not search.improves(0.502, 0.5, 0.01)
    assert search.improves(0.4, 0.5, 0.01, "minimize") and not search.improves(0.52, 0.5, 0.01, "minimize")


def test_parameters_out_of_range_raise():
    for name, params in (("XGBClassifier", {"max_depth": 40}), ("XGBClassifier", {"learning_rate": 2.0}), ("RandomForestClassifier", {"max_depth": 31}), ("SVC", {"kernel": "rbf"})):
        with pytest.raises((ValueError, NotImplementedError)):
            learners.make_learner(name, params)


def test_svc_cost_counts_the_rows_it_is_fitted_on(spark):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([x / 10, (x * 7 % 10) / 10]), float(x > 20)) for x in range(40)], ["features", "label"])
    ours = learners.make_learner("SVC", {"C": 2.0}).fit(df)
    plain = LinearSVC(regParam=1 / 80, standardization=False).fit(df)
    assert ours.coefficients.toArray().tolist() == plain.coefficients.toArray().tolist()


def test_nearest_neighbours_with_ties_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    refs = rng.integers(-1, 2, (60, 3)).astype(float)
    refs[0] = 0
    queries = rng.integers(-1, 2, (40, 3)).astype(float) + 0.5
    monkeypatch.setattr(learners, "KNN_TILE_ROWS", 7)
    frame = lambda m: spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "id long, vec array<double>, label int")
    got = learners.knn_cosine(frame(queries), frame(refs), 5, block_rows=16).toPandas()
    for q, own in got.groupby("qid"):
        norm = np.linalg.norm(refs, axis=1)
        sims = np.divide(refs @ queries[q], norm * np.linalg.norm(queries[q]), out=np.full(60, -np.inf), where=norm > 0)
        want = sorted(range(60), key=lambda i: (-round(sims[i], 12), i))[:5]
        assert sorted(np.round(own.sim, 9)) == sorted(np.round(sims[want], 9)) and len(own) == 5


@pytest.mark.parametrize("method", ["soft", "stacking"])
def test_saved_ensembles_of_other_methods_predict(spark, method):
    from tabula.plans import jobs

    t = fx.train(spark, SF_SMALL)
    members = {"f": ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4}, ["x_price", "c_status"]), "g": ("XGBClassifier", {"n_estimators": 3, "max_depth": 3}, ["x_price", "x_month"])}
    path = scratch_path(spark, "ensemble-test")
    jobs.save_ensemble(spark, path, members, {"f": 0.5, "g": 0.5}, ["x_price"], t.schema, method=method)
    loaded, _, features, _ = jobs.load_ensemble(spark, path)
    assert loaded["g"][2] == ["x_price", "x_month"] and features == ["x_price", "c_status", "x_month"]
    out = jobs.predict_job(spark, t, t.drop("class"), path, scratch_path(spark, "predictions"))
    both = out.withColumnRenamed("class", "p").join(t, "id")
    assert out.count() == t.count() and both.where("p = class").count() > 0.6 * t.count()
    with pytest.raises(ValueError):
        jobs.save_ensemble(spark, path, members, {"f": 0.5, "g": 0.5}, ["x_price"], t.schema, method="median")
