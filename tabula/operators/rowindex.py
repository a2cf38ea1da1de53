"""Distributed row numbering without a single-partition window.

``row_number() over (order by k)`` (no PARTITION BY) moves every row into one
task. Instead:

1. the leading order column is mapped to a number by a MONOTONE function
   (numbers as doubles, timestamps as microseconds) and cut into ``n`` buckets
   at approximate quantiles (one ``percentile_approx`` aggregate; only the
   ``n - 1`` cut points reach the driver). Text keys are cut at values of the key
   itself, taken from the ``SAMPLE_KEYS`` keys that come first by their hash; the
   sample bears on the balance of the buckets only. Either way
   ``(bucket, order_cols)`` sorts exactly like ``order_cols``;
2. one aggregate counts rows per (group, bucket); prefix sums over that small
   table give each bucket's offset (AQE broadcasts it when small);
3. rows are hash-partitioned on (group, bucket) and numbered with
   ``row_number()`` inside each bucket; index = offset + number - 1.

Every step is a pure function of the data: no cached copy, no partition ids,
no ``monotonically_increasing_id``. A lost executor recomputes exactly the same
numbers. With ``group_cols`` the numbering restarts per group while a hot
group (one key holding a large share of all rows) is still spread over all
buckets. The order columns must form a total order (end them with a unique
key); the leading column should have many distinct values, because rows
sharing one mapped value share one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY, _BUCKET, _CNT, _OFF, _RN = "__ri_key", "__ri_bucket", "__ri_cnt", "__ri_off", "__ri_rn"
_LOWEST = -1.0e308


def _monotone_key(df: DataFrame, c: str | Column) -> Column:
    """A double that never decreases when the column value increases (Spark's
    ascending order, NULLs first)."""
    if isinstance(c, Column):
        expr = c
        dtype = df.select(c).schema.fields[0].dataType
    else:
        expr = F.col(c)
        dtype = df.schema[c].dataType
    if isinstance(dtype, T.NumericType):
        key = expr.cast("double")
    elif isinstance(dtype, T.BooleanType):
        key = expr.cast("int").cast("double")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        key = F.unix_micros(expr.cast("timestamp")).cast("double")
    else:
        raise TypeError(f"unsupported leading order type {dtype.simpleString()}")
    return F.coalesce(key, F.lit(_LOWEST))


SAMPLE_KEYS = 10_000


def _text_bucket(df: DataFrame, c: str | Column, n: int) -> Column | None:
    """Bucket of a text or binary key: how many cut points it reaches. None for other types."""
    expr = c if isinstance(c, Column) else F.col(c)
    dtype = df.select(expr.alias("k")).schema["k"].dataType
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        return None
    keys = df.select(expr.alias("k")).where(F.col("k").isNotNull()).distinct()
    keys = sorted(bytes(r.k) if isinstance(dtype, T.BinaryType) else r.k for r in keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLE_KEYS).collect())
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []

    def search(lo: int, hi: int) -> Column:  # cuts[:lo] are reached, cuts[hi:] aren't
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(expr >= F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(expr.isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))


def _bucketed(df: DataFrame, order_cols: Sequence[str | Column], n: int) -> DataFrame:
    """``df`` with the bucket of its leading order column: rows of a lower bucket come first."""
    text = _text_bucket(df, order_cols[0], n)
    if text is not None:
        return df.withColumn(_BUCKET, text)
    keyed = df.withColumn(_KEY, _monotone_key(df, order_cols[0]))
    probs = [i / n for i in range(1, n)]
    cuts: list[float] = []
    if probs:
        got = keyed.select(F.percentile_approx(_KEY, probs, 10_000).alias("q")).first()["q"] or []
        cuts = sorted({float(v) for v in got if v is not None and v > _LOWEST})
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=_KEY, outputCol=_BUCKET, handleInvalid="keep").transform(keyed)
    return bucketed.withColumn(_BUCKET, F.col(_BUCKET).cast("int")).drop(_KEY)


def reached(
    df: DataFrame, order_cols: Sequence[str], positions: Callable[[int], list[int]], num_partitions: int | None = None
) -> tuple[int, list[Column]]:
    """The row count, and for each 0-based position (a function of the count) whether a row
    stands at it or behind it in ``order_cols`` order.

    Only the buckets that hold one of the positions are ranked; the keys found there (one for
    each position) become literals, so the result is a narrow projection. The order
    columns must be a total order of numbers, booleans or texts."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = _bucketed(df, order_cols, n).select(*order_cols, _BUCKET)
    counts = {r[_BUCKET]: r[_CNT] for r in bucketed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias(_CNT)).collect()}  # at most n + 1 buckets
    total = sum(counts.values())
    wanted, places = positions(total), {}
    before = 0
    for bucket in sorted(counts):
        for p in wanted:
            if before <= p < before + counts[bucket]:
                places[p] = (bucket, p - before + 1)
        before += counts[bucket]
    keys = {}
    if places:
        ranked = bucketed.where(F.col(_BUCKET).isin(sorted({b for b, _ in places.values()})))
        ranked = ranked.withColumn(_RN, F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*order_cols)))
        at = F.struct(F.col(_BUCKET).cast("int"), F.col(_RN).cast("int"))
        hits = ranked.where(at.isin([F.struct(F.lit(b).cast("int"), F.lit(r).cast("int")) for b, r in sorted(set(places.values()))]))
        keys = {(r[_BUCKET], r[_RN]): r for r in hits.collect()}
    types = {c: df.schema[c].dataType for c in order_cols}
    out = []
    for p in wanted:
        if p <= 0:
            out.append(F.lit(True))
        elif p >= total:
            out.append(F.lit(False))
        else:
            key = keys[places[p]]
            out.append(F.struct(*[F.col(c) for c in order_cols]) >= F.struct(*[F.lit(key[c]).cast(types[c]).alias(c) for c in order_cols]))
    return total, out


def nulls_first(row: Row) -> tuple:
    return tuple((v is not None, v) for v in row)


def reached_in_groups(
    df: DataFrame,
    order_cols: Sequence[str],
    group_col: str,
    positions: Callable[[dict[object, tuple[int, Row]]], dict[object, list[int]]],
    num_partitions: int | None = None,
) -> dict[object, list[Column]]:
    """:func:`reached` within each group of a column of few values: for each of a group's
    0-based positions, whether a row of that group stands at it or behind it.

    ``positions`` maps each group to its places, given each group's size and first key. One
    aggregate counts all (group, bucket) cells; only cells with a wanted position are ranked;
    the driver gets ``groups * (partitions + 1)`` counts and one key per position."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = _bucketed(df, order_cols, n).select(F.col(group_col).alias("__g"), *order_cols, _BUCKET)
    cells: dict[object, dict[int, int]] = {}
    first: dict[object, Row] = {}
    for r in bucketed.groupBy("__g", _BUCKET).agg(F.count(F.lit(1)).alias(_CNT), F.min(F.struct(*order_cols)).alias("__first")).collect():
        cells.setdefault(r["__g"], {})[r[_BUCKET]] = r[_CNT]
        first[r["__g"]] = min(first.get(r["__g"], r["__first"]), r["__first"], key=nulls_first)
    sizes = {g: sum(c.values()) for g, c in cells.items()}
    wanted = positions({g: (sizes[g], first[g]) for g in cells})
    places: dict[tuple[object, int], tuple[int, int]] = {}
    for g, points in wanted.items():
        before = 0
        for bucket in sorted(cells[g]):
            for p in points:
                if before <= p < before + cells[g][bucket]:
                    places[g, p] = (bucket, p - before + 1)
            before += cells[g][bucket]
    keys: dict[tuple[object, int, int], Row] = {}
    if places:
        spots = sorted({(g, b, rn) for (g, _), (b, rn) in places.items()}, key=repr)
        schema = T.StructType([T.StructField("__sg", bucketed.schema["__g"].dataType), T.StructField("__sb", T.IntegerType()), T.StructField("__sr", T.IntegerType())])
        spot = F.broadcast(df.sparkSession.createDataFrame(spots, schema))  # one row per position
        cell = F.broadcast(spot.select("__sg", "__sb").distinct())
        at = F.col("__g").eqNullSafe(F.col("__sg")) & (F.col(_BUCKET) == F.col("__sb"))
        ranked = bucketed.join(cell, at, "left_semi").withColumn(_RN, F.row_number().over(Window.partitionBy("__g", _BUCKET).orderBy(*order_cols)))
        for r in ranked.join(spot, at & (F.col(_RN) == F.col("__sr")), "left_semi").collect():
            keys[r["__g"], r[_BUCKET], r[_RN]] = r
    types = {c: df.schema[c].dataType for c in order_cols}

    def behind(g: object, p: int) -> Column:
        if p <= 0:
            return F.lit(True)
        if p >= sizes[g]:
            return F.lit(False)
        key = keys[g, *places[g, p]]
        return F.struct(*[F.col(c) for c in order_cols]) >= F.struct(*[F.lit(key[c]).cast(types[c]).alias(c) for c in order_cols])

    return {g: [behind(g, p) for p in points] for g, points in wanted.items()}


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    name: str = "row_idx",
    group_cols: Sequence[str] = (),
    num_partitions: int | None = None,
    total_name: str | None = None,
) -> DataFrame:
    """Add a 0-based ``name`` = position of the row in ``order_cols`` order
    (within ``group_cols`` if given); ``total_name`` also adds the row count
    (of the group), taken from the same per-bucket counts (no extra scan)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = _bucketed(df, order_cols, n)
    counts = bucketed.groupBy(*group_cols, _BUCKET).agg(F.count(F.lit(1)).alias(_CNT))
    w_off = Window.partitionBy(*group_cols).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(_OFF, F.coalesce(F.sum(_CNT).over(w_off), F.lit(0)).cast("long"))
    offsets = offsets.withColumn("__ri_total", F.sum(_CNT).over(Window.partitionBy(*group_cols)).cast("long")).drop(_CNT)

    w_rn = Window.partitionBy(*group_cols, _BUCKET).orderBy(*order_cols)
    numbered = bucketed.repartition(n, *group_cols, _BUCKET).withColumn(_RN, F.row_number().over(w_rn))
    # renamed copies: both sides derive from ``bucketed`` (avoid self-join ambiguity)
    o = offsets.select(
        *[F.col(g).alias(f"__ri_g{i}") for i, g in enumerate(group_cols)], F.col(_BUCKET).alias("__ri_ob"), _OFF, "__ri_total"
    )
    cond = F.col(_BUCKET) == F.col("__ri_ob")
    for i, g in enumerate(group_cols):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__ri_g{i}"))
    joined = numbered.join(o, cond, "inner")
    idx = (F.col(_OFF) + F.col(_RN) - F.lit(1)).cast("long").alias(name)
    extra = [F.col("__ri_total").alias(total_name)] if total_name else []
    return joined.select(*[F.col(c) for c in df.columns], idx, *extra)


def with_group_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column], name: str) -> DataFrame:
    """1-based row number within each group, skew-safe."""
    return with_row_index(df, order_cols, name=name, group_cols=group_cols).withColumn(name, F.col(name) + 1)
