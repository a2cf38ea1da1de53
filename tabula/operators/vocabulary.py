"""Category vocabularies as Spark tables (T4), for columns of any number of values.

``StringIndexer`` collects a column's labels to the driver and writes them into plan
metadata; that suits cleaned columns (at most 100 values each). Here the vocabulary is a
table ``(column, idx, value)``: distinct filled values, ranked per column by the
distributed row index, so a column of many values is spread over all tasks. Encoding is a
join on ``(column, value)``, and the assembled vectors are sparse, without a metadata entry
per category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.exprs import MISSING_CATEGORY
from tabula.operators.rowindex import with_row_index
from tabula.session import scratch_path

BROADCAST_ROWS = 500_000
"""Vocabularies up to so many rows go to every executor; larger ones are joined by shuffle."""


def _long(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """(keep, column, value) of the text columns, missing values filled."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING_CATEGORY)).alias("value")) for c in cols])
    return df.select(*keep, F.inline(cells))


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, idx, value)``: the values of each column after the fill, numbered from 0 in
    binary order. No rows for an empty table."""
    values = _long(df, cols).distinct()
    ranked = with_row_index(values, ["value"], "idx", group_cols=["column"])
    return ranked.select("column", F.col("idx").cast("int").alias("idx"), "value")


def slots(vocab: DataFrame, cols: Sequence[str], first: int = 0) -> DataFrame:
    """``(column, value, slot)``: vector places from ``first`` on, column after column, without
    each column's value 0."""
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column"))
    sizes = vocab.groupBy("column").agg((F.count(F.lit(1)) - 1).alias("width"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row per column
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("width").over(before), F.lit(0)) + F.lit(first)).select("column", "offset")
    # one row per column
    return vocab.where("idx > 0").join(F.broadcast(offsets), "column").select("column", "value", (F.col("offset") + F.col("idx") - 1).cast("int").alias("slot"))


def encode(df: DataFrame, places: DataFrame, cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, slot, value)``: a 1 at the place of each row's category; a column's first value
    and unseen ones have none. A frequent category is one row of the vocabulary: the join
    broadcasts a vocabulary of checked size, else adaptive execution splits the frequent key."""
    if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    hit = _long(df, cols, id_col).join(places, ["column", "value"])
    return hit.select(id_col, "slot", F.lit(1.0).alias("value"))


def assemble(df: DataFrame, vocab: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, features)``: the (prepared) numeric columns, then the one-hot places, as sparse vectors.

    Equals the assembled vector of :func:`tabula.operators.preprocess.build_preprocessing`
    for the same vocabulary. ``id_col`` is unique."""
    places = slots(vocab, cat_cols, len(num_cols))
    width = len(num_cols) + places.count()
    ones = encode(df, places, cat_cols, id_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("__ones"))  # at most one per column
    rows = df.select(F.col(id_col), *[F.col(f"`{c}`").cast("double").alias(f"__n{i}") for i, c in enumerate(num_cols)]).join(ones, id_col, "left")
    numbers = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"__n{i}").alias("value")) for i in range(len(num_cols))]).cast("array<struct<slot:int,value:double>>")
    cells = F.concat(numbers, F.coalesce("__ones", F.array().cast("array<struct<slot:int,value:double>>")))
    kept = F.filter(cells, lambda c: c["value"].isNull() | (c["value"] != 0.0))
    # a vector's stored form; read back under the vector type
    nan = F.lit(float("nan"))
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"),
        F.transform(kept, lambda c: c["slot"]).alias("indices"), F.transform(kept, lambda c: F.coalesce(c["value"], nan)).alias("values"),
    )
    path = scratch_path(df.sparkSession, "vectors")
    rows.select(id_col, stored.alias("features")).write.parquet(path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)
