"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back:
    cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


FEW = 1 << 20
"""Rows of keys that may be broadcast (20 to 60 MB as a hash table)."""

BATCH_BYTES = 1 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends: what the next query needs of it was
    written by ``stored``. The session's setting comes back afterwards."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's rows go to the Python workers in Arrow batches of BATCH_BYTES (else of
    10,000 rows): the JVM and the worker hold a batch whole. Later queries aren't bound by it:
    the session's setting comes back."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose values in the columns of ``keys`` (a few numbers each) are a row
    of it: up to FEW rows are broadcast, so that no row of ``df`` moves; more are joined by a shuffle."""
    few = keys.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(keys) if few else keys, keys.columns, "left_semi")
