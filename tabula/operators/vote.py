"""Weighted votes and exhaustive ensemble-subset scoring (V1-V9).

Votes over predictions that are already one row per id are narrow
projections (no shuffle). The all-subset evaluation (V9) is rewritten so that
the data is scanned ONCE: rows are grouped by ``(fold, prediction pattern,
label)``; a vote depends only on the pattern, so every subset is scored on the
small pattern table (at most ``folds * classes^n * classes`` rows) instead of
re-reading the data ``2^n - 1`` times.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.functions.exprs import struct_min_label

# subsets are numbered by a 64-bit bitmap
BITMAP_MODELS = 62

LOW_BITS = 10


def with_bitmaps(df: DataFrame, n: int) -> DataFrame:
    """Each row with every bitmap ``1 .. 2^n - 1``. Rows are first spread by the
    high bits, so no task expands more than ``2^LOW_BITS`` subsets of a row at once."""
    if n > BITMAP_MODELS:
        raise ValueError(f"a bitmap holds {BITMAP_MODELS} models, not {n}")
    high = max(0, n - LOW_BITS)
    low = F.sequence(F.lit(0).cast("long"), F.lit(2 ** (n - high) - 1).cast("long"))
    spread = df
    if high:
        tops = F.sequence(F.lit(0).cast("long"), F.lit(2**high - 1).cast("long"))
        spread = df.withColumn("__high", F.explode(tops)).repartition("__high")
    bitmap = (F.col("__high") if high else F.lit(0).cast("long")) * F.lit(2 ** (n - high)) + F.col("__low")
    out = spread.withColumn("__low", F.explode(low)).withColumn("bitmap", bitmap).where("bitmap > 0")
    return out.drop("__high", "__low")


def has_bit(bitmap: Column, j: Column) -> Column:
    """True when bit ``j`` (a column) of ``bitmap`` is set."""
    return bitmap.bitwiseAND(F.pow(F.lit(2), j).cast("long")) != 0


# --------------------------------------------------------------------- V1
def ensemble_weights(results: DataFrame, direction: str = "maximize", score_col: str = "score") -> DataFrame:
    """Weights from scores: maximize ``s/sum``, minimize ``1 - s/sum``, equal ``1/n``."""
    both = results.agg(F.sum(score_col).alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, n = F.lit(both["total"]), F.lit(both["n"])
    if direction == "maximize":
        w = F.col(score_col) / total
    elif direction == "minimize":
        w = F.lit(1.0) - F.col(score_col) / total
    elif direction == "equal":
        w = F.lit(1.0) / n
    else:
        raise ValueError(f"unknown direction {direction!r}")
    return results.withColumn("weight", w.cast("double"))


# --------------------------------------------------------------------- V2 / V5
def hard_vote_expr(preds: Sequence[Column], weights: Sequence[float | Column]) -> Column:
    """Weighted plurality label of one row: each model gives its weight to its
    label; the label with the largest total wins, ties -> smallest label.
    NULL predictions abstain."""
    ws = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    scores = []
    for p_i in preds:
        s = F.lit(0.0)
        for p_j, w_j in zip(preds, ws):
            s = s + F.when(p_j == p_i, w_j).otherwise(F.lit(0.0))
        scores.append(s)
    return struct_min_label(scores, preds)


def vote_hard(df: DataFrame, weights: Mapping[str, float], id_col: str = "id", out_col: str = "prediction") -> DataFrame:
    """V2 on wide predictions ``(id, m1, ..., mn)``: narrow, no shuffle."""
    models = list(weights)
    return df.select(id_col, hard_vote_expr([F.col(m) for m in models], [weights[m] for m in models]).alias(out_col))


def vote_hard_long(long: DataFrame, weights: DataFrame, id_col: str = "id") -> DataFrame:
    """V2 on long predictions ``(id, model, prediction)`` with a weights table
    ``(model, weight)``: sum by (id, label) then the top label per id. Used when
    the number of models is too large for a per-row expression."""
    from pyspark.sql import Window

    mass = long.join(F.broadcast(weights), "model").groupBy(id_col, "prediction").agg(F.sum("weight").alias("mass"))
    w = Window.partitionBy(id_col).orderBy(F.col("mass").desc(), F.col("prediction").asc())
    return mass.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(id_col, "prediction", "mass")


# --------------------------------------------------------------------- V3 / V4 / V6
def _scaled(arr: Column, w: float) -> Column:
    wl = F.lit(float(w))
    return F.transform(arr, lambda x: x * wl)


def soft_vote_mass(prob_arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """Per-class weighted probability mass: sum_i w_i * p_i(class)."""
    acc = None
    for arr, w in zip(prob_arrays, weights):
        term = _scaled(arr, w)
        acc = term if acc is None else F.zip_with(acc, term, lambda a, b: a + b)
    return acc


def argmax_index(arr: Column) -> Column:
    """0-based position of the largest value; ties -> first position."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def vote_soft(
    df: DataFrame,
    prob_cols: Mapping[str, float],
    classes: Sequence[int] = (0, 1),
    id_col: str = "id",
    target_class: int | None = None,
) -> DataFrame:
    """V3 (label) or V4 (mass of ``target_class``) from per-model probability
    arrays ordered like ``classes``."""
    models = list(prob_cols)
    mass = soft_vote_mass([F.col(m) for m in models], [prob_cols[m] for m in models])
    out = df.select(id_col, mass.alias("__mass"))
    if target_class is not None:
        pos = list(classes).index(target_class)
        return out.select(id_col, F.col("__mass")[pos].alias("probability"))
    cls = F.array(*[F.lit(c) for c in classes])
    return out.select(id_col, F.element_at(cls, argmax_index(F.col("__mass")) + 1).alias("prediction"))


def binary_proba_array(p1: Column) -> Column:
    """``[p(0), p(1)]`` from the probability of class 1."""
    return F.array(F.lit(1.0) - p1, p1)


def argmax_label(prob: Column, classes: Sequence[int] = (0, 1)) -> Column:
    """V6: a model's label from its probability array."""
    cls = F.array(*[F.lit(c) for c in classes])
    return F.element_at(cls, argmax_index(prob) + 1)


# --------------------------------------------------------------------- V7
def align_predictions(frames: Mapping[str, DataFrame], id_col: str = "id", value_col: str = "prediction") -> DataFrame:
    """Index-aligned concat of per-model predictions: one union + one pivot
    (a single shuffle by id) instead of a chain of full outer joins."""
    long = None
    for name, f in frames.items():
        part = f.select(id_col, F.lit(name).alias("model"), F.col(value_col).alias("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(id_col).pivot("model", list(frames)).agg(F.first("value"))


# --------------------------------------------------------------------- V8
def ensemble_subsets(models: DataFrame, n: int, name_col: str = "name", pos_col: str = "position", sep: str = "-") -> DataFrame:
    """V8: every non-empty subset by bitmap ``1 .. 2^n - 1``; bit ``j`` selects
    the model at position ``j``. Rows ``(bitmap, combination, member, weight...)``."""
    if n > BITMAP_MODELS:
        raise ValueError(f"a bitmap holds {BITMAP_MODELS} models, not {n}")
    spark = models.sparkSession
    bitmaps = spark.range(1, 2**n).withColumnRenamed("id", "bitmap")
    members = bitmaps.select(
        "bitmap",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: has_bit(F.col("bitmap"), j))).alias(pos_col),
    )
    joined = members.join(models, pos_col)
    names = joined.groupBy("bitmap").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos_col, name_col))), lambda s: s[name_col]), sep).alias("combination")
    )
    return joined.join(names, "bitmap")


# --------------------------------------------------------------------- V9
def subset_vote_expr(bitmap: Column, preds: Column, weights: Column, n: int) -> Column:
    """Hard weighted vote restricted to the members of ``bitmap`` (array form)."""
    members = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: has_bit(bitmap, j))

    def score_of(i):
        return F.aggregate(
            members,
            F.lit(0.0),
            lambda acc, j: acc + F.when(F.element_at(preds, j + 1) == F.element_at(preds, i + 1), F.element_at(weights, j + 1)).otherwise(F.lit(0.0)),
        )

    cands = F.transform(members, lambda i: F.struct((-score_of(i)).alias("neg"), F.element_at(preds, i + 1).alias("label")))
    return F.array_min(cands).getField("label")


def subset_scores(
    df: DataFrame,
    models: Sequence[str],
    weights: Sequence[float],
    label_col: str,
    fold_col: str = "fold",
    sep: str = "-",
) -> DataFrame:
    """V9: accuracy of the weighted hard vote of EVERY non-empty subset of
    ``models`` on every fold: ``(combination, fold, score)``.

    One scan groups rows into prediction patterns; subsets are expanded on the
    pattern table, spread over all tasks (no join)."""
    n = len(models)
    patterns = df.groupBy(fold_col, label_col, *models).agg(F.count(F.lit(1)).alias("__cnt"))
    preds = F.array(*[F.col(m) for m in models])
    wts = F.array(*[F.lit(float(w)) for w in weights])
    names = F.array(*[F.lit(m) for m in models])
    expanded = with_bitmaps(patterns.select(fold_col, label_col, "__cnt", preds.alias("__p")), n)
    voted = expanded.withColumn("__v", subset_vote_expr(F.col("bitmap"), F.col("__p"), wts, n))
    per = voted.groupBy("bitmap", fold_col).agg(
        (F.sum(F.when(F.col("__v") == F.col(label_col), F.col("__cnt")).otherwise(0)).cast("double") / F.sum("__cnt")).alias("score")
    )
    member_names = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(has_bit(F.col("bitmap"), j), F.element_at(names, j + 1))),
        lambda x: x.isNotNull(),
    )
    return per.select(F.array_join(member_names, sep).alias("combination"), F.col(fold_col).alias("fold"), "score", "bitmap")
