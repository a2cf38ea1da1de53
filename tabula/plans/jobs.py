"""End-to-end jobs: search (H2, H3, H8), ensemble build (V17), prediction
(V18) and ensemble persistence (S11).

The driver only orchestrates: every fit, score and aggregate is a Spark job
over the full tables; what reaches the driver is bounded by the number of
trials, parameters and members (never by rows).
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.ml import Estimator, Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators import cleaning, learners, metrics, ridge_cv, vote
from tabula.operators.candidates import FeatureSet, model_candidates, pending_candidates
from tabula.operators import preprocess as pp
from tabula.operators.folds import head_fraction, kfold_stratified, sample_exact
from tabula.plans import ensemble as ens
from tabula.plans import search
from tabula.plans.fitted import fit_or_load
from tabula.plans.reports import prediction_parity
from tabula.plans.stacking import TARGETS, Stacking
from tabula.session import checkpointed
from tabula.sources import csv as csvio
from tabula.sources import store

log = logging.getLogger(__name__)


def run_id() -> str:
    """Run ids are minute timestamps ``yyyyMMddHHmm``."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M")


# ---------------------------------------------------------------- H2 objective
def _trial_params(rows) -> list[dict]:
    out: dict[int, dict] = {}
    for r in rows:
        d = out.setdefault(r["number"], {})
        d[r["param"]] = r["choice"] if r["choice"] is not None else r["value"]
    for d in out.values():
        for k, v in list(d.items()):
            if isinstance(v, float) and v.is_integer() and k in ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf",
                                                                "n_neighbors", "p", "num_leaves", "iterations", "depth",
                                                                "border_count", "one_hot_max_size", "od_wait"):
                d[k] = int(v)
    return [out[k] for k in sorted(out)]


def cv_objective(
    df: DataFrame,
    model_name: str,
    trials: Sequence[Mapping],
    features: Sequence[str],
    label_col: str,
    n_cv: int = 5,
    parallelism: int = 4,
) -> list[float | None]:
    """Mean stratified K-fold accuracy of the full pipeline for each parameter
    set. All ridge parameter sets and folds come from one pass of sums
    (:mod:`tabula.operators.ridge_cv`). For other learners, preprocessing doesn't
    depend on the parameters: it is fitted once per fold, on the other folds
    (leak-free), and the encoded fold is cached for all learners. Trials whose parameters have no distributed
    counterpart come back as ``None`` (failed)."""
    ests: list[Estimator | None] = []
    for i, t in enumerate(trials):
        try:
            ests.append(learners.make_learner(model_name, dict(t), label_col=label_col))
        except (NotImplementedError, ValueError) as e:
            log.warning("trial %d fails: %s", i, e)
            ests.append(None)
    todo = [i for i, e in enumerate(ests) if e is not None]
    folded = kfold_stratified(df, n_cv, label_col, ["id"]).persist()
    scores = dict(zip(todo, _cv_accuracies([ests[i] for i in todo], folded, features, label_col, n_cv, parallelism), strict=True))
    folded.unpersist()
    return [scores.get(i) for i in range(len(trials))]


def members_cv_accuracy(df: DataFrame, members: ens.Members, features: Sequence[str], label_col: str, n_cv: int = 5) -> dict[str, float]:
    """Mean stratified K-fold accuracy of each member. All members share the folds, and
    those of equal columns each fold's preprocessing and encoding."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, member in members.items():
        groups.setdefault(tuple(ens.member_features(member, features)), []).append(name)
    used = dict.fromkeys(["id", label_col, *(c for cols in groups for c in cols)])
    folded = kfold_stratified(df.select(*used), n_cv, label_col, ["id"]).persist()
    scores: dict[str, float] = {}
    for cols, names in groups.items():
        ests = [learners.make_learner(*members[n][:2], label_col=label_col) for n in names]
        scores.update(zip(names, _cv_accuracies(ests, folded, list(cols), label_col, n_cv), strict=True))
    folded.unpersist()
    return {n: scores[n] for n in members}


def _cv_accuracies(ests: Sequence[Estimator], folded: DataFrame, features: Sequence[str], label_col: str, n_cv: int, parallelism: int = 4) -> list[float]:
    """Mean accuracy of each estimator over the folds: ridges by sums, the others fold by fold."""
    ridges = [i for i, e in enumerate(ests) if isinstance(e, learners.RidgeClassifier)]
    others = [i for i in range(len(ests)) if i not in ridges]
    scores: dict[int, float] = {}
    if ridges:
        scores.update(zip(ridges, ridge_cv.ridge_cv_accuracies(folded, features, label_col, [ests[i].getOrDefault("alpha") for i in ridges]), strict=True))
    scores.update(zip(others, _scores_fold_by_fold([ests[i] for i in others], folded, features, label_col, n_cv, parallelism), strict=True))
    return [scores[i] for i in range(len(ests))]


def _scores_fold_by_fold(ests: Sequence[Estimator], folded: DataFrame, features: Sequence[str], label_col: str, n_cv: int, parallelism: int) -> list[float]:
    """Mean accuracy of each estimator, one fold after the other."""
    total = [0.0] * len(ests)
    for fold in range(n_cv) if ests else ():
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        prep = pp.build_preprocessing(folded.schema, features_in=features).fit(train)
        enc = prep.transform(train).select("id", label_col, "features").persist()
        held = prep.transform(test).select("id", label_col, "features")  # read once, for all estimators
        for i, score in enumerate(_fold_accuracies(ests, enc, held, label_col, parallelism)):
            total[i] += score / n_cv
        enc.unpersist()
    return total


def _fold_accuracies(ests: Sequence[Estimator], train: DataFrame, test: DataFrame, label_col: str, parallelism: int) -> list[float]:
    """Accuracy on ``test`` of each estimator fitted on ``train`` (both encoded); ``test`` is read once."""
    if all(isinstance(e, learners.RidgeClassifier) for e in ests):
        models = learners.fit_ridges(ests, train)
    else:
        with ThreadPoolExecutor(max_workers=max(1, min(len(ests), parallelism))) as pool:
            models = list(pool.map(lambda est: est.fit(train), ests))
    scored = test
    for i, model in enumerate(models):
        hit = (F.col("prediction") == F.col(label_col)).cast("double")
        scored = model.transform(scored).select(*test.columns, *[f"__hit{j}" for j in range(i)], hit.alias(f"__hit{i}"))
    return list(scored.agg(*[F.avg(f"__hit{i}").alias(f"s{i}") for i in range(len(models))]).first())


# ---------------------------------------------------------------- H3 study
def search_study(
    spark: SparkSession,
    df: DataFrame,
    candidate: str,
    model_name: str,
    features: Sequence[str],
    label_col: str,
    trials_root: str,
    n_trials: int,
    batch: int = 4,
    n_cv: int = 5,
    patience: int = 20,
    min_improvement: float = 0.001,
    seed: int = 42,
    direction: str = "maximize",
    run: str = "",
) -> DataFrame:
    """Up to ``n_trials`` further trials in batches, resuming the study of ``run``;
    stops after ``patience`` trials without a qualifying improvement: what a
    batch holds beyond that trial isn't recorded. Returns the study's top-3 rows."""
    if direction not in ("maximize", "minimize"):
        raise ValueError(f"unknown direction {direction!r}")
    existing = store.read_trials(spark, trials_root, run).where(F.col("study") == candidate)
    state = search.patience_state(existing, min_improvement, direction).first() if not existing.isEmpty() else None
    best = state["best_value"] if state else None
    count = int(state["no_improvement_count"]) if state else 0
    start = (existing.select(F.max("number")).first()[0] + 1) if state else 0
    done = 0
    while done < n_trials and count < patience:
        size = min(batch, n_trials - done)
        keys = spark.range(start, start + size).select(F.lit(candidate).alias("study"), F.col("id").alias("number"))
        sampled = search.sample_trials(keys, [model_name], seed=seed).collect()  # size x params rows
        params = _trial_params(sampled)
        scores = cv_objective(df, model_name, params, features, label_col, n_cv)
        rows = []
        for i, s in enumerate(scores):  # the early-stopping callback, trial by trial (bounded by the batch)
            rows.append((candidate, start + i, s, "COMPLETE" if s is not None else "FAIL", json.dumps(params[i])))
            if search.improves(s, best, min_improvement, direction):
                best, count = s, 0
            else:
                count += 1
            if count >= patience:
                break
        batch_df = spark.createDataFrame(rows, "study string, seq long, value double, state string, params string")
        store.append_trials(spark, trials_root, batch_df, run=run, batch_id=f"{candidate}-{start}")
        start += size
        done += size
    trials = store.read_trials(spark, trials_root, run).where(F.col("study") == candidate)
    top = search.top_trials(trials, 3, direction).join(trials.select("number", "params"), "number")
    n = trials.count()
    return top.select(
        F.concat(F.lit(candidate), F.lit("top_"), F.col("rank").cast("string")).alias("name"),
        F.col("value").alias("score"),
        "params",
        F.lit(model_name).alias("model"),
        F.lit(json.dumps(list(features))).alias("features"),
        F.lit(n).cast("int").alias("n_trials"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit(candidate).alias("study"),
    )


# ---------------------------------------------------------------- H8 job
def search_job(
    spark: SparkSession,
    train: DataFrame,
    models: Sequence[str],
    features: Sequence[str] | Sequence[FeatureSet],
    results_root: str,
    trials_root: str,
    limit_data_percentage: float = 0.15,
    n_trials: int = 4,
    batch: int = 2,
    n_cv: int = 5,
    patience: int = 20,
    min_improvement: float = 0.001,
    run: str | None = None,
    direction: str = "maximize",
) -> DataFrame:
    """Load -> first rows -> clean + label -> candidates -> skip finished ->
    search each pending candidate -> save top results.

    ``features`` is one list of columns, or feature sets: then every model is
    searched with every combination of the optional sets (F1)."""
    run = run or run_id()
    data = head_fraction(train, limit_data_percentage, ["id"])
    data = cleaning.engineer_features(data).withColumn("class", F.col("class").cast("double")).persist()
    cands = model_candidates(models, features)
    names = spark.createDataFrame([(c,) for c in cands], "name string")
    done = store.load_run_results(spark, results_root, run)
    pending = {r["name"] for r in pending_candidates(names, done).collect()}  # at most the candidates
    meta = json.dumps({"limit_data_percentage": limit_data_percentage})
    for cand, (model_name, columns) in cands.items():
        if cand not in pending:
            continue
        top = search_study(spark, data, cand, model_name, columns, "class", trials_root, n_trials, batch, n_cv, patience, min_improvement,
                           direction=direction, run=run)
        store.save_results(top.withColumn("metadata", F.lit(meta)), results_root, run)
    data.unpersist()
    return store.load_run_results(spark, results_root, run)


# ---------------------------------------------------------------- V17 / V18 / S11
METHODS = ("hard", "soft", "stacking")


def save_ensemble(spark: SparkSession, path: str, members: ens.Members, weights: Mapping[str, float], features: Sequence[str], schema,
                  method: str = "hard", target: str = "predict", meta_model: tuple[str, Mapping] | None = None) -> str:
    """Members are saved UNFITTED (pipeline + parameters, each with its
    columns); prediction fits them on all training rows, or loads what was fitted
    on these rows before. ``method`` is how they decide together: hard or soft
    vote, or stacking, where ``meta_model`` (model, parameters) reads the
    members' labels or, by ``target``, probabilities."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
    meta = json.dumps(meta_model) if meta_model else None
    rows = [(i, n, m[0], json.dumps(m[1]), float(weights[n]), json.dumps(ens.member_features(m, features)), method, target, meta) for i, (n, m) in enumerate(members.items())]
    columns = "place int, name string, model string, params string, weight double, features string, method string, target string, meta string"
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    for n, m in members.items():
        ens.member_pipeline(schema, m[0], m[1], ens.member_features(m, features), "class").write().overwrite().save(f"{path}/members/{n}")
    return path


def load_ensemble(spark: SparkSession, path: str) -> tuple[dict, dict, list[str], dict[str, Pipeline]]:
    """(members, weights, all members' columns, unfitted pipelines)."""
    cfg = spark.read.parquet(f"{path}/config").orderBy("place").collect()  # one row per member
    members = {r["name"]: (r["model"], json.loads(r["params"]), json.loads(r["features"])) for r in cfg}
    weights = {r["name"]: r["weight"] for r in cfg}
    features = list(dict.fromkeys(c for m in members.values() for c in m[2]))
    pipes = {r["name"]: Pipeline.load(f"{path}/members/{r['name']}") for r in cfg}
    return members, weights, features, pipes


def ensemble_decision(spark: SparkSession, path: str) -> tuple[str, str, tuple[str, dict] | None]:
    """(method, target, meta model) of a saved ensemble."""
    row = spark.read.parquet(f"{path}/config").select("method", "target", "meta").first()
    return row["method"], row["target"], tuple(json.loads(row["meta"])) if row["meta"] else None


def ensemble_job(
    spark: SparkSession,
    train: DataFrame,
    results: DataFrame,
    selection: Sequence[str],
    features: Sequence[str],
    out_dir: str,
    sample_fraction: float = 0.1,
    n_cv: int = 5,
    optimize: bool = True,
    test: bool = False,
    seed: int = 42,
    direction: str = "maximize",
    run: str | None = None,
    method: str = "hard",
    target: str = "predict",
    meta_model: tuple[str, Mapping] | None = None,
) -> DataFrame:
    """Selected results -> sample -> weights -> clean -> optimise (all
    subsets) or test -> scores CSV -> final members -> saved ensemble. The scores and
    the ensemble of each run have a folder of their own. A result that names its features
    gives a member with these columns; ``method`` is saved for prediction.

    Subsets are optimised only where labels are voted on: with a ``meta_model`` (method
    stacking) or the probability ``target``, ``test`` or neither is done."""
    if meta_model:
        method = "stacking"
    optimize = optimize and target == "predict" and not meta_model
    run = run or run_id()
    w_df = vote.ensemble_weights(store.select_results(results, selection), direction)
    stored_features = F.col("features") if "features" in w_df.columns else F.lit(None).cast("string")
    w_df = w_df.select("name", "model", "params", "weight", stored_features.alias("features"))
    cfg = w_df.collect()  # one row per member
    members = {r["name"]: (r["model"], json.loads(r["params"]) if r["params"] else {}, json.loads(r["features"] or "[]")) for r in cfg}
    weights = {r["name"]: float(r["weight"]) for r in cfg}
    sample = sample_exact(train, sample_fraction, "id", seed=seed)
    data = cleaning.engineer_features(sample)  # sample_order is a number: it isn't cleaned
    data = data.withColumn("class", F.col("class").cast("double")).persist()
    names = list(members)
    if optimize:
        scores = ens.optimize_ensemble(data, members, [weights[n] for n in names], features, "class", n_cv, ["sample_order", "id"], extra=["bitmap"])
        bitmap = scores.where("is_best").first()["bitmap"]
        best = [n for j, n in enumerate(names) if bitmap >> j & 1]
    elif test:
        scores = ens.test_ensemble(data, members, [weights[n] for n in names], features, "class", n_cv, ["sample_order", "id"])
        best = names
    else:
        scores = spark.createDataFrame([], "combination string, score double")
        best = names
    csvio.write_csv(scores.select("combination", "score"), f"{out_dir}/ensemble_results_{run}")
    final = {n: members[n] for n in names if n in best}
    total = sum(weights[n] for n in final)
    final_w = {n: weights[n] / total for n in final}  # restricted and renormalised
    save_ensemble(spark, f"{out_dir}/ensemble_{run}", final, final_w, features, data.schema, method, target, meta_model)
    data.unpersist()
    return scores


def predict_job(spark: SparkSession, train: DataFrame, test: DataFrame, ensemble_dir: str, out_path: str) -> DataFrame:
    """Load the ensemble, clean both tables with TRAIN statistics, fit
    members on all train rows (or load those fitted on equal rows before), vote or
    stack, decode labels, write ``id,class`` CSV."""
    members, weights, features, _ = load_ensemble(spark, ensemble_dir)
    cats = cleaning.string_columns(train, exclude=("class",))
    kept = cleaning.fit_category_filter(train, cats)
    tr = cleaning.label_targets(cleaning.clean_categorical(train, cats, fitted=kept)).withColumn("class", F.col("class").cast("double"))
    te = cleaning.clean_categorical(test, cats, fitted=kept)
    tr = tr.persist()
    method, target, meta = ensemble_decision(spark, ensemble_dir)
    config = {"members": {n: list(m) for n, m in members.items()}, "features": features}
    if method == "stacking":
        stage = Stacking(members, features, "class", meta=meta, target=target)
        config |= {p.name: v for p, v in stage.extractParamMap().items()}
        model = fit_or_load(f"{ensemble_dir}/fitted", tr, config, lambda df: {"stacking": stage.fit(df)})["stacking"]
        voted = model.transform(te).withColumn("prediction", F.col("prediction").cast("int"))
    else:
        models = fit_or_load(f"{ensemble_dir}/fitted", tr, config, lambda df: ens.fit_members(df, members, features, "class"))
        voted = (ens.hard_vote_predict if method == "hard" else ens.soft_vote_predict)(models, te, weights)
    out = cleaning.unlabel_targets(voted.withColumnRenamed("prediction", "class"))
    csvio.write_csv(out.select("id", "class"), out_path)
    tr.unpersist()
    return csvio.read_csv_table(spark, out_path, "id bigint, class string")


def prediction_parity_check(models: Mapping, df: DataFrame, alone: Mapping) -> DataFrame:
    """R4 for fitted members: predictions made inside the voting ensemble vs
    the stand-alone models ``alone`` (should never differ)."""
    inside = ens.predict_members(models, df, ["id"])
    outside = None
    for n, m in alone.items():
        one = m.transform(df).select("id", F.col("prediction").cast("int").alias(n))
        outside = one if outside is None else outside.join(one, "id", "full_outer")
    return prediction_parity(inside, outside, list(models))


def fitted_parity(df: DataFrame, members: ens.Members, features: Sequence[str], path: str) -> DataFrame:
    """An ensemble fitted, saved and loaded against each member's whole pipeline fitted by itself on the same rows."""
    df = df.persist()
    config = {"members": {n: list(m) for n, m in members.items()}, "features": list(features)}
    fit = lambda rows: ens.fit_members(rows, members, features, "class")
    fit_or_load(path, df, config, fit)
    loaded = fit_or_load(path, df, config, fit)
    alone = {n: ens.member_pipeline(df.schema, m[0], m[1], ens.member_features(m, features), "class").fit(df) for n, m in members.items()}
    out = checkpointed(prediction_parity_check(loaded, df, alone))
    df.unpersist()
    return out


def members_accuracy(preds: DataFrame, names: Sequence[str], label_col: str) -> DataFrame:
    return metrics.model_accuracy(preds, names, label_col)
