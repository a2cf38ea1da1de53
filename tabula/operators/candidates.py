"""Feature-set screening and candidate bookkeeping.

F1 enumerates feature-set combinations by bitmap (mandatory sets first, then
optional ones by bit). Instead of launching a full search per combination,
all combinations are screened in ONE aggregate: a grouping set per subset of the
columns gives the class counts of every key; the majority class per key yields
the training accuracy of the "majority per key" rule for that feature subset.
``grouping_id()`` tells real NULLs from absent columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSet:
    name: str
    features: tuple[str, ...]
    is_optional: bool = True


def model_candidates(models: Sequence[str], features: Sequence[str] | Sequence[FeatureSet]) -> dict[str, tuple[str, list[str]]]:
    """``{candidate name: (model, columns)}``: each model with the columns, or with the required
    feature sets and each subset of the optional ones. A candidate is called after its
    model and sets, each with an underscore behind."""
    if not any(isinstance(f, FeatureSet) for f in features):
        return {f"{m}_": (m, list(features)) for m in models}
    optional = [f for f in features if f.is_optional]
    out = {}
    for model in models:
        for mask in range(1 << len(optional)):  # bit j as in feature_set_ablation: optional set j
            taken = [f for f in features if not f.is_optional or mask >> optional.index(f) & 1]
            columns = list(dict.fromkeys(c for f in taken for c in f.features))
            if columns:
                out["_".join([model, *(f.name for f in taken), ""])] = (model, columns)
    return out


def feature_set_ablation(df: DataFrame, columns: Sequence[str], label_col: str) -> DataFrame:
    """Accuracy of the majority-class-per-key rule for every subset of
    ``columns``: ``(mask, features, n_keys, accuracy)``; bit ``j`` of ``mask``
    is ``columns[j]``. Ties between classes go to the smaller label (the
    accuracy does not depend on it)."""
    cols = list(columns)
    # one row per key and class first, then one grouping set per subset, each keeping the label
    base = df.groupBy(*cols, label_col).agg(F.count(F.lit(1)).alias("__n"))
    ncol = len(cols)
    sets = [[c for j, c in enumerate(cols) if mask >> j & 1] + [label_col] for mask in range(1 << ncol)]
    grouped = base.groupingSets([[F.col(c) for c in g] for g in sets], *cols, label_col).agg(F.sum("__n").alias("__n"), F.grouping_id().alias("__gid"))
    absent = lambda j: F.col("__gid").bitwiseAND(F.lit(1 << (ncol - j)))
    mask = sum(F.when(absent(j) == 0, F.lit(1 << j)).otherwise(F.lit(0)) for j in range(ncol))
    names = F.concat_ws("_", *[F.when(absent(j) == 0, F.lit(cols[j])) for j in range(ncol)])
    keyed = grouped.select(*cols, "__n", mask.alias("mask"), names.alias("features"))
    top = keyed.groupBy("mask", "features", *cols).agg(F.max("__n").alias("__n"))
    return top.groupBy("mask", "features").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("__n").alias("__hits"))


def ablation_accuracy(df: DataFrame, columns: Sequence[str], label_col: str) -> DataFrame:
    n = df.select(F.count(F.lit(1))).scalar()
    out = feature_set_ablation(df, columns, label_col)
    return out.select("mask", "features", "n_keys", (F.col("__hits").cast("double") / n).alias("accuracy"))


def pending_candidates(candidates: DataFrame, results: DataFrame, k: int = 3, name_col: str = "name") -> DataFrame:
    """candidates with none of ``<name>top_0 .. top_{k-1}`` stored yet."""
    suffixes = F.array(*[F.lit(f"top_{i}") for i in range(k)])
    wanted = candidates.select(name_col, F.explode(suffixes).alias("__s")).select(
        name_col, F.concat(F.col(name_col), F.col("__s")).alias("__stored")
    )
    done = wanted.join(results.select(F.col(name_col).alias("__stored")), "__stored", "left_semi").select(name_col)
    return candidates.join(done, name_col, "left_anti")
