"""Accuracy and fold metrics (E5-E10) as conditional aggregates.

Per-fold scores for any number of models come from ONE pass: predictions are
unpivoted to ``(model, fold, prediction, y)`` inside the scan and aggregated
with map-side partial sums, so the shuffle carries one row per
(task, model, fold) instead of one per input row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_predictions(
    df: DataFrame, models: Sequence[str], keep: Sequence[str] = (), model_col: str = "model", value_col: str = "prediction"
) -> DataFrame:
    """Wide ``(id, m1, m2, ...)`` -> long ``(id, model, prediction)``."""
    return df.select(
        *keep,
        F.explode(F.array(*[F.struct(F.lit(m).alias(model_col), F.col(m).alias(value_col)) for m in models])).alias("__kv"),
    ).select(*keep, f"__kv.{model_col}", f"__kv.{value_col}")


def _hit(pred: str, y: str):
    return F.when(F.col(pred) == F.col(y), F.lit(1)).otherwise(F.lit(0))


def accuracy(df: DataFrame, pred_col: str, label_col: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: share of rows whose prediction equals the label (optionally per group)."""
    return df.groupBy(*by).agg((F.sum(_hit(pred_col, label_col)).cast("double") / F.count(F.lit(1))).alias("accuracy"))


def aligned_accuracy(pred: DataFrame, truth: DataFrame, id_col: str, pred_col: str, label_col: str) -> DataFrame:
    """E5 with index alignment: inner join on the id, then accuracy."""
    return accuracy(pred.join(truth, id_col, "inner"), pred_col, label_col)


def model_accuracy(df: DataFrame, models: Sequence[str], label_col: str) -> DataFrame:
    """Accuracy of each prediction column over all rows: ``(model, accuracy)``."""
    long = unpivot_predictions(df, models, keep=[label_col])
    return accuracy(long, "prediction", label_col, by=["model"])


def fold_scores(df: DataFrame, models: Sequence[str], label_col: str, fold_col: str = "fold") -> DataFrame:
    """``(combination, fold, score)``: each model's accuracy on each fold."""
    long = unpivot_predictions(df, models, keep=[label_col, fold_col])
    return (
        accuracy(long, "prediction", label_col, by=["model", fold_col])
        .withColumnRenamed("model", "combination")
        .withColumnRenamed("accuracy", "score")
        .withColumnRenamed(fold_col, "fold")
    )


def mean_score_by_combination(scores: DataFrame) -> DataFrame:
    """Mean fold score per combination."""
    return scores.groupBy("combination").agg(F.avg("score").alias("score"))


def best_combination(mean_scores: DataFrame, sep: str = "-") -> DataFrame:
    """Highest mean score, ties to the lexicographically first name; the
    members come back as rows (``member``, ``position``)."""
    top = mean_scores.orderBy(F.col("score").desc(), F.col("combination").asc()).limit(1)
    return top.select(
        "combination", "score", F.posexplode(F.split(F.col("combination"), sep, -1)).alias("position", "member")
    )


def classification_metrics(df: DataFrame, models: Sequence[str], label_col: str, fold_col: str = "fold", positive: int = 1) -> DataFrame:
    """Per model and fold accuracy, precision, recall and F1 of the positive
    class (0 when undefined), from one conditional-sum aggregate."""
    long = unpivot_predictions(df, models, keep=[label_col, fold_col])
    p = F.col("prediction") == F.lit(positive)
    t = F.col(label_col) == F.lit(positive)
    agg = long.groupBy("model", fold_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(p & t, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(p & ~t, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~p & t, 1).otherwise(0)).alias("fn"),
        F.sum(_hit("prediction", label_col)).alias("hits"),
    )
    prec = F.when(F.col("tp") + F.col("fp") == 0, F.lit(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") == 0, F.lit(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(0.0)).otherwise(
        2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )
    return agg.select(
        "model",
        F.col(fold_col).alias("fold"),
        (F.col("hits") / F.col("n")).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        f1.alias("f1"),
    )


def fold_model_pivot(scores: DataFrame, combinations: Sequence[str]) -> DataFrame:
    """rows = folds, one column per combination (values listed up front so
    the pivot needs no extra distinct job)."""
    return scores.groupBy("fold").pivot("combination", list(combinations)).agg(F.first("score"))
