"""Ensemble jobs.

Members are Spark ML ``PipelineModel``s (or rule columns in the catalog
fixtures). Per fold each member is fitted once and scored once; the scored
fold table is checkpointed to the shared checkpoint folder, and every subset
is then evaluated from its prediction-pattern aggregate (see
:func:`tabula.operators.vote.subset_scores`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.operators import metrics, vote
from tabula.operators import preprocess as pp
from tabula.operators.folds import kfold_contiguous, kfold_shuffled
from tabula.operators.learners import make_learner
from tabula.session import checkpointed


# ---------------------------------------------------------------- rule-model forms
def optimize_ensemble_rules(df: DataFrame, models: Sequence[str], weights: Sequence[float], label_col: str, fold_col: str = "fold",
                            extra: Sequence[str] = ()) -> DataFrame:
    """V10 on precomputed per-fold predictions: mean accuracy of every subset
    and a flag for the best (max mean, ties -> first name). ``extra=["bitmap"]`` adds
    the subset itself: its names alone may be ambiguous."""
    s = vote.subset_scores(df, models, weights, label_col, fold_col)
    ms = s.groupBy("bitmap", "combination").agg(F.round(F.avg("score"), 12).alias("score"))
    best = ms.orderBy(F.col("score").desc(), F.col("combination").asc()).limit(1).select(F.col("combination").alias("__best"))
    return ms.join(best, F.col("combination") == F.col("__best"), "left").select(
        "combination", "score", F.col("__best").isNotNull().alias("is_best"), *extra
    )


def test_ensemble_rules(df: DataFrame, models: Sequence[str], weights: Sequence[float], label_col: str, fold_col: str = "fold") -> DataFrame:
    """Per fold each member's accuracy and the full ensemble's, averaged
    over folds: ``(combination, score)``."""
    full = "-".join(models)
    voted = df.withColumn(full, vote.hard_vote_expr([F.col(m) for m in models], list(weights)))
    s = metrics.fold_scores(voted, [*models, full], label_col, fold_col)
    return metrics.mean_score_by_combination(s).select("combination", F.round("score", 12).alias("score"))


def final_members(results: DataFrame, best: DataFrame, member_col: str = "member", key: str = "study") -> DataFrame:
    """Keep the result rows named in the best combination (semi join)."""
    return results.join(best.select(F.col(member_col).alias(key)).distinct(), key, "left_semi")


def oof_mean_threshold(df: DataFrame, x_col: str, fold_col: str = "fold") -> DataFrame:
    """Out-of-fold predictions of a one-parameter rule (V12 on a rule model):
    for fold f the threshold is the mean of ``x_col`` over the other folds,
    obtained from ONE per-fold aggregate by subtraction from the totals."""
    from pyspark.sql import Window

    per = df.groupBy(fold_col).agg(F.sum(x_col).alias("__sx"), F.count(x_col).alias("__nx"))
    everything = Window.partitionBy()  # over the k per-fold rows only
    th = per.select(
        fold_col,
        ((F.sum("__sx").over(everything) - F.col("__sx")) / (F.sum("__nx").over(everything) - F.col("__nx"))).alias("threshold"),
    )
    # one row per fold
    out = df.join(F.broadcast(th), fold_col)
    return out.select(
        "*", F.when(F.col(x_col) > F.col("threshold"), F.lit(1)).otherwise(F.lit(0)).alias("prediction")
    )


def weights_by_name(weights: DataFrame, names: Sequence[str]) -> Mapping[str, float]:
    got = {r["name"]: float(r["weight"]) for r in weights.select("name", "weight").collect()}
    return {n: got[n] for n in names}


# ---------------------------------------------------------------- fitted members


# (model, parameters), or (model, parameters, columns) for a member with columns of its own
Members = Mapping[str, tuple]


def member_pipeline(schema, model_name: str, params: dict, features: Sequence[str], label_col: str) -> Pipeline:
    est = make_learner(model_name, params, label_col=label_col)
    return pp.build_preprocessing(schema, features_in=features, model=est, model_name=model_name)


def member_features(member: tuple, features: Sequence[str]) -> list[str]:
    return list(member[2]) if len(member) > 2 and member[2] else list(features)


def _fit_on_one_encoding(prep: PipelineModel, learners: Mapping[str, Estimator], df: DataFrame, label_col: str) -> dict[str, PipelineModel]:
    """Each learner fitted on the rows of ``df`` that ``prep`` encodes; lazy learners need the rows' ids."""
    from concurrent.futures import ThreadPoolExecutor

    keep = [c for c in ("id", label_col) if c in df.columns]
    encoded = prep.transform(df).select(*keep, "features").persist()

    def fit_one(name):
        return name, PipelineModel(stages=[*prep.stages, learners[name].fit(encoded)])

    with ThreadPoolExecutor(max_workers=max(1, min(len(learners), 4))) as pool:
        fitted = dict(pool.map(fit_one, learners))
    encoded.unpersist()
    return fitted


def fit_members(df: DataFrame, members: Members, features: Sequence[str], label_col: str) -> dict[str, PipelineModel]:
    """Fit every member on ``df``. Members with equal columns share one fitted
    preprocessing and one cached encoding; a small driver thread pool submits the
    learners concurrently so the cluster runs them side by side."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, member in members.items():
        groups.setdefault(tuple(member_features(member, features)), []).append(name)
    fitted: dict[str, PipelineModel] = {}
    for cols, names in groups.items():
        prep = pp.build_preprocessing(df.schema, features_in=list(cols)).fit(df)
        learners = {n: make_learner(*members[n][:2], label_col=label_col) for n in names}
        fitted.update(_fit_on_one_encoding(prep, learners, df, label_col))
    return {n: fitted[n] for n in members}


def fit_pipelines(pipes: Mapping[str, Pipeline], df: DataFrame, label_col: str) -> dict[str, PipelineModel]:
    """Fits unfitted pipelines that end in a learner. Those whose stages before it are alike (but
    for their uids) share them once fitted, and their encoding."""
    groups: dict[str, list[str]] = {}
    for name, pipe in pipes.items():
        stages = [(type(s).__name__, sorted((p.name, repr(v)) for p, v in s.extractParamMap().items())) for s in pipe.getStages()[:-1]]
        # default output names hold the uid
        alike = repr(stages)
        for s in pipe.getStages()[:-1]:
            alike = alike.replace(s.uid, type(s).__name__)
        groups.setdefault(alike, []).append(name)
    fitted: dict[str, PipelineModel] = {}
    for names in groups.values():
        prep = Pipeline(stages=pipes[names[0]].getStages()[:-1]).fit(df)
        fitted.update(_fit_on_one_encoding(prep, {n: pipes[n].getStages()[-1] for n in names}, df, label_col))
    return {n: fitted[n] for n in pipes}


def predict_members(models: Mapping[str, PipelineModel], df: DataFrame, keep: Sequence[str], method: str = "predict") -> DataFrame:
    """One column per member: the label (``predict``) or the probability
    array (``predict_proba``). Members without probabilities raise. Members that
    were fitted on one preprocessing read one encoding."""
    if method not in ("predict", "predict_proba"):
        raise ValueError(f"Prediction method {method} not recognized. Use 'predict' or 'predict_proba'")
    groups: dict[tuple[int, ...], list[str]] = {}
    for name, model in models.items():
        groups.setdefault(tuple(map(id, model.stages[:-1])), []).append(name)
    out = df.select(*keep, *[c for c in df.columns if c not in keep])
    for names in groups.values():
        encoded = PipelineModel(stages=models[names[0]].stages[:-1]).transform(out)
        for name in names:
            scored = models[name].stages[-1].transform(encoded)
            if method == "predict_proba" and "probability" not in scored.columns:
                raise ValueError(f"{name} gives no probabilities")
            val = F.col("prediction").cast("int") if method == "predict" else vector_to_array(F.col("probability"))
            encoded = scored.select(*encoded.columns, val.alias(name))
        out = encoded.select(*out.columns, *names)
    return out.select(*keep, *models)


def score_members(fit_df: DataFrame, apply_df: DataFrame, members: Members, features: Sequence[str], label_col: str, method: str = "predict") -> DataFrame:
    """Fit members on ``fit_df`` and return long predictions ``(id, model, prediction)``."""
    models = fit_members(fit_df, members, features, label_col)
    wide = predict_members(models, apply_df, ["id"], method)
    return metrics.unpivot_predictions(wide, list(members), keep=["id"])


def fold_predictions(df: DataFrame, members: Members, features: Sequence[str], label_col: str, k: int, order_cols: Sequence[str]) -> DataFrame:
    """Per fold: fit members on the other folds, predict the fold. Returns the
    checkpointed wide table ``(id, fold, label, m1..mn)``."""
    f = checkpointed(kfold_contiguous(df, k, order_cols))
    parts = []
    for i in range(k):
        tr, te = f.where(F.col("fold") != i), f.where(F.col("fold") == i)
        models = fit_members(tr, members, features, label_col)
        parts.append(predict_members(models, te, ["id", "fold", label_col]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return checkpointed(out)


def optimize_ensemble(df: DataFrame, members: Members, weights: Sequence[float], features: Sequence[str], label_col: str,
                      k: int = 5, order_cols: Sequence[str] = ("id",), extra: Sequence[str] = ()) -> DataFrame:
    """fit/predict once per fold, then score all subsets from the pattern table."""
    preds = fold_predictions(df, members, features, label_col, k, order_cols)
    return optimize_ensemble_rules(preds, list(members), weights, label_col, extra=extra)


def test_ensemble(df: DataFrame, members: Members, weights: Sequence[float], features: Sequence[str], label_col: str,
                  k: int = 5, order_cols: Sequence[str] = ("id",)) -> DataFrame:
    """V11 with fitted members."""
    preds = fold_predictions(df, members, features, label_col, k, order_cols)
    return test_ensemble_rules(preds, list(members), weights, label_col)


# ---------------------------------------------------------------- votes and stacking
def meta_learner(label_col: str) -> Estimator:
    """The stacking meta learner if none is named."""
    return LogisticRegression(labelCol=label_col, maxIter=50)


def soft_vote_predict(models: Mapping[str, PipelineModel], df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """V3 with fitted members: weighted probability mass per class, argmax."""
    probs = predict_members(models, df, ["id"], method="predict_proba")
    return vote.vote_soft(probs, weights)


def hard_vote_predict(models: Mapping[str, PipelineModel], df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    preds = predict_members(models, df, ["id"])
    return vote.vote_hard(preds, weights)


def compare_ensembles(df: DataFrame, members: Members, features: Sequence[str], label_col: str, k: int = 3, inner_k: int = 3) -> DataFrame:
    """CV accuracy of soft voting and of stacking on probabilities: two rows ``(model, score)``."""
    from tabula.plans.stacking import Stacking

    f = checkpointed(kfold_contiguous(df, k, ["id"]))
    w = {n: 1.0 / len(members) for n in members}
    soft, stack = [], []
    for i in range(k):
        tr, te = f.where(F.col("fold") != i).drop("fold"), f.where(F.col("fold") == i).drop("fold")
        models = fit_members(tr, members, features, label_col)
        sv = soft_vote_predict(models, te, w).join(te.select("id", label_col), "id")
        soft.append(sv.select(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()[0])
        # the stacked members are those of the vote: fitted on the same rows
        st = Stacking(members, features, label_col, k=inner_k, target="predict_proba").fit_over(models, tr).transform(te)
        stack.append(st.select(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()[0])
    spark = df.sparkSession
    return spark.createDataFrame([("soft_voting", float(np.mean(soft))), ("stacking", float(np.mean(stack)))], "model string, score double")
