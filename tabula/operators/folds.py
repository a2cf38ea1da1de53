"""Fold assignment (E1-E4) and order-based row selection.

Every routine derives positions from the distributed row index
(:mod:`tabula.operators.rowindex`) plus a few scalar counts, so no step needs
a single-partition window or a driver-side loop over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.exprs import hash_order_key
from tabula.operators.rowindex import nulls_first, reached, reached_in_groups, with_row_index

# Fixed value: seed of the shuffled K-fold used for stacking.
STACKING_FOLD_SEED = 1000000007

MAX_CLASSES = 32


def kfold_contiguous(df: DataFrame, k: int, order_cols: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """Unshuffled K-fold: contiguous blocks in ``order_cols`` order."""
    if k < 2:
        raise ValueError("k must be at least 2")
    # the first n % k folds hold one extra row
    _, behind = reached(df, order_cols, lambda n: [i * (n // k) + min(i, n % k) for i in range(1, k)])
    return df.withColumn(fold_col, sum((b.cast("int") for b in behind), F.lit(0)))


def kfold_shuffled(df: DataFrame, k: int, id_col: str, seed: int = STACKING_FOLD_SEED, fold_col: str = "fold") -> DataFrame:
    """Seeded random equal folds (E2): contiguous folds over a hash order."""
    keyed = df.withColumn("__fold_key", hash_order_key(seed, id_col))
    return kfold_contiguous(keyed, k, ["__fold_key", id_col], fold_col).drop("__fold_key")


def kfold_stratified(df: DataFrame, k: int, label_col: str, order_cols: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """Unshuffled stratified K-fold.

    Classes are ordered by first appearance; class ``c`` takes positions
    ``[s, s+m)`` of the class-sorted order and fold ``i`` receives as many of
    its rows as there are positions ``p`` in that range with ``p % k == i``,
    as contiguous blocks of the class's rows in row order. Rows without a label
    are a class of their own. Up to MAX_CLASSES classes, the blocks' first keys
    are found in one pass and become literals: no row is moved.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    if df.select(label_col).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        return _stratified_by_rank(df, k, label_col, order_cols, fold_col)

    def ends(classes: dict) -> dict:
        """For each class, in how many rows its folds 0 .. k - 2 end."""
        out, start = {}, 0
        for label in sorted(classes, key=lambda c: nulls_first(classes[c][1])):
            size = classes[label][0]
            # positions p < x with p mod k = i: (x + k - 1 - i) // k
            shares = [(start + size + k - 1 - i) // k - (start + k - 1 - i) // k for i in range(k)]
            out[label] = [sum(shares[: i + 1]) for i in range(k - 1)]
            start += size
        return out

    fold = F.lit(None).cast("int")
    for label, behind in reached_in_groups(df, order_cols, label_col, ends).items():
        same = F.col(label_col).eqNullSafe(F.lit(label).cast(df.schema[label_col].dataType))
        fold = F.when(same, sum((b.cast("int") for b in behind), F.lit(0))).otherwise(fold)
    return df.withColumn(fold_col, fold)


def _stratified_by_rank(df: DataFrame, k: int, label_col: str, order_cols: Sequence[str], fold_col: str) -> DataFrame:
    """The same folds for any number of classes: every row gets its rank within its class."""
    classes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__m"), F.min(F.struct(*order_cols)).alias("__first"))
    # one row per class: a window over this small table is cheap
    w = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__s", F.coalesce(F.sum("__m").over(w), F.lit(0)).cast("long")).drop("__first")
    ranked = with_row_index(df, order_cols, name="__j", group_cols=[label_col])
    j = F.col("__j")
    s, m = F.col("__s"), F.col("__m")
    cum = F.lit(0).cast("long")
    fold = None
    for i in range(k):
        alloc = (F.floor((s + m - 1 - i) / F.lit(float(k))) - F.floor((s - 1 - i) / F.lit(float(k)))).cast("long")
        cum = cum + alloc
        fold = F.when(j < cum, F.lit(i)) if fold is None else fold.when(j < cum, F.lit(i))
    fold = fold.otherwise(F.lit(k - 1))
    classes = classes.withColumnRenamed(label_col, "__class")
    out = ranked.join(classes, F.col(label_col).eqNullSafe(F.col("__class")), "inner").withColumn(fold_col, fold.cast("int"))
    return out.drop("__j", "__s", "__m").select(*df.columns, fold_col)


def fold_split_counts(df: DataFrame, fold_col: str = "fold", label_col: str | None = None) -> DataFrame:
    """Train/test sizes per fold (E4): test = the fold, train = the complement."""
    aggs = [F.count(F.lit(1)).alias("n_test")]
    if label_col is not None:
        aggs.append(F.sum(F.col(label_col).cast("long")).alias("n_pos_test"))
    per_fold = df.groupBy(fold_col).agg(*aggs)
    everything = Window.partitionBy()  # over the k per-fold rows only
    out = per_fold.withColumn("n_train", (F.sum("n_test").over(everything) - F.col("n_test")).cast("long"))
    if label_col is not None:
        out = out.withColumn("n_pos_train", (F.sum("n_pos_test").over(everything) - F.col("n_pos_test")).cast("long"))
    return out


def train_test_for_fold(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def head_fraction(df: DataFrame, fraction: float, order_cols: Sequence[str]) -> DataFrame:
    """First ``int(n * fraction)`` rows in ``order_cols`` order (P5)."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    _, (behind,) = reached(df, order_cols, lambda n: [math.floor(n * fraction)])
    return df.where(~behind)


def split_halves(df: DataFrame, order_cols: Sequence[str], half_col: str = "half") -> DataFrame:
    """Head and tail ``int(n * 0.5)`` rows (P9); an odd middle row is in neither."""
    _, (past_head, in_tail) = reached(df, order_cols, lambda n: [n // 2, n - n // 2])
    half = F.when(~past_head, F.lit("head")).when(in_tail, F.lit("tail"))
    return df.withColumn(half_col, half).where(F.col(half_col).isNotNull())


def sample_exact(df: DataFrame, fraction: float, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows without replacement (P6), chosen by a
    seeded hash order; ``sample_order`` keeps that (shuffled) order for later
    contiguous folds."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    keyed = df.withColumn("__sk", hash_order_key(seed, id_col))
    _, (behind,) = reached(keyed, ["__sk", id_col], lambda n: [round(n * fraction)])
    return with_row_index(keyed.where(~behind), ["__sk", id_col], "sample_order").drop("__sk")
