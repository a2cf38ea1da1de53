"""Stateless streaming batch prediction.

New files landing in a folder are scored by a fitted voting ensemble and the
decoded labels go to an output table, partitioned by epoch (``read_scores``
leaves that column out). The reference has no
streaming; this shows the prediction step (V18) runs unchanged on a streaming
frame. Each micro-batch is written through ``foreachBatch`` with the query's
checkpoint in the shared checkpoint folder, so a restarted query resumes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabula.operators import cleaning
from tabula.plans.ensemble import hard_vote_predict
from tabula.session import scratch_path


def score_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    models: Mapping[str, PipelineModel],
    weights: Mapping[str, float],
    out_dir: str,
    kept: DataFrame | None = None,
    checkpoint_dir: str | None = None,
) -> None:
    """Score every file currently in ``source_dir`` (``availableNow``) and stop."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    cats = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType) and f.name != "class"]

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = cleaning.clean_categorical(batch, cats, fitted=kept) if (kept is not None and cats) else batch
        voted = hard_vote_predict(models, rows, weights).withColumnRenamed("prediction", "class")
        # a replayed micro-batch replaces what it wrote before
        cleaning.unlabel_targets(voted).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    q = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def read_scores(spark: SparkSession, out_dir: str) -> DataFrame:
    """What :func:`score_stream` wrote, without the epoch its folders are named by."""
    return spark.read.parquet(out_dir).drop("epoch")
