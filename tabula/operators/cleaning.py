"""Projection, coercion, categorical cleaning and label mapping.

Rare-category cleaning runs as ONE aggregate for all columns: the table is
unpivoted to ``(column, value)`` and counted with map-side partial
aggregation. A kept category needs ``count >= share * total``, so at most
``1 / share`` values per column survive: they go into the row-level replacement
as literals, whatever the data size.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.exprs import INT_TO_LABEL, LABEL_TO_INT, MISSING_CATEGORY, RARE_SHARE, map_values

log = logging.getLogger(__name__)


def select_features(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project ``columns`` in the given order (P1); ``None`` keeps everything."""
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*[c for c in keep if c not in columns], *columns)


def split_xy(df: DataFrame, id_col: str | Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Features keyed by id (target dropped) and the target keyed by id."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return df.drop(target), df.select(*ids, target)


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


# what pandas takes for a number; a cast alone would also take '1d' and '2f'
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI]nf(?:inity)?|[nN]a[nN])\s*$"


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All-or-nothing numeric coercion per column (P4): a string column becomes
    double only if every non-null value parses; otherwise it is left as is.
    One aggregate pass decides all columns."""
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        return df
    checks = [F.bool_and(F.col(c).isNull() | F.col(c).rlike(_NUMBER)).alias(c) for c in cols]
    flags = df.agg(*checks).first().asDict()  # one row of booleans, one per column
    out = [
        (F.expr(f"try_cast(`{c}` as double)").alias(c) if (c in cols and flags.get(c)) else F.col(c))
        for c in df.columns
    ]
    return df.select(*out)


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("kv")
    ).select("kv.column", "kv.value")


def category_counts(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Count per non-null value and column (C1): ``(column, value, count)``."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    return _long_values(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    # one row per column: bounded by the schema width
    return counts.join(F.broadcast(totals), "column")


def rare_categories(df: DataFrame, columns: str | Sequence[str], share: float = RARE_SHARE) -> DataFrame:
    """Values whose count is strictly below ``share`` of the non-null rows."""
    t = _with_totals(category_counts(df, columns))
    return t.where(F.col("count") < F.lit(share) * F.col("total")).select("column", "value", "count", "total")


def fit_category_filter(df: DataFrame, columns: Sequence[str], share: float = RARE_SHARE) -> DataFrame:
    """Kept (non-rare) categories per column. At most ``floor(1/share)`` rows per
    column, so the result is broadcast-safe."""
    t = _with_totals(category_counts(df, columns))
    return t.where(F.col("count") >= F.lit(share) * F.col("total")).select("column", "value")


def apply_category_filter(df: DataFrame, kept: DataFrame, columns: Sequence[str], marker: str = MISSING_CATEGORY) -> DataFrame:
    """Replace rare and NULL values by ``marker`` (C3): a narrow projection.
    The kept table is computed once; it has at most ``1 / share`` values a column."""
    values: dict[str, list[str]] = {c: [] for c in columns}
    for r in kept.where(F.col("column").isin(list(columns))).collect():
        values[r["column"]].append(r["value"])
    text = {c: F.col(c).cast("string") for c in columns}
    return df.select(*[F.when(text[c].isin(values[c]), text[c]).otherwise(F.lit(marker)).alias(c) if c in values else F.col(c) for c in df.columns])


def clean_categorical(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = ("class",),
    share: float = RARE_SHARE,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """C4: rare/NULL -> 'dna' for every string column (target excluded by
    default). ``fitted`` (a kept table from another frame) gives fit-on-train
    semantics; by default statistics come from ``df`` itself."""
    cols = list(columns) if columns is not None else string_columns(df, exclude)
    if not cols:
        return df
    kept = fitted if fitted is not None else fit_category_filter(df, cols, share)
    return apply_category_filter(df, kept, cols)


def clean_long(df: DataFrame, id_col: str, columns: Sequence[str], share: float = RARE_SHARE) -> DataFrame:
    """Long form of C4: ``(id, column, value, cleaned)`` for all columns at once."""
    kept = fit_category_filter(df, columns, share).withColumnRenamed("value", "__kv")
    long = df.select(
        id_col,
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv"),
    ).select(id_col, "kv.column", "kv.value")
    joined = long.join(
        F.broadcast(kept), (long["column"] == kept["column"]) & (long["value"] == kept["__kv"]), "left"
    ).select(long[id_col], long["column"], long["value"], F.coalesce(F.col("__kv"), F.lit(MISSING_CATEGORY)).alias("cleaned"))
    return joined


def label_targets(df: DataFrame, target: str = "class") -> DataFrame:
    """C5: 'p' -> 1, 'e' -> 0, anything else -> NULL."""
    if target not in df.columns:
        log.warning("labels are left as they are: %r is no column", target)
        return df
    return df.withColumn(target, map_values(target, LABEL_TO_INT).cast("int"))


def unlabel_targets(df: DataFrame, target: str = "class") -> DataFrame:
    """1 -> 'p', 0 -> 'e', anything else -> NULL."""
    if target not in df.columns:
        raise ValueError(f"column {target!r} is required")
    return df.withColumn(target, map_values(target, INT_TO_LABEL).cast("string"))


def engineer_features(
    df: DataFrame, target: str = "class", clean_target: bool = False, fitted: DataFrame | None = None
) -> DataFrame:
    """C7 = C4 then C5. ``clean_target=True`` also cleans the target like the
    original workflow did; ``fitted`` reuses train statistics on another frame."""
    exclude = () if clean_target else (target,)
    return label_targets(clean_categorical(df, exclude=exclude, fitted=fitted), target)
