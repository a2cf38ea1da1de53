"""Store of fitted models (S11): what was fitted on equal rows with equal parameters is loaded.

A model's folder is named by a digest of its parameters, the columns' types and every
training row, whatever the rows' order. An attempt writes a folder of its own and names it
in a marker that is written last, so a lost driver leaves nothing that could be read
half, and two writers don't mix.
"""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable, Mapping

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.plans.stacking import StackingModel
from tabula.sources.csv import _path_exists

log = logging.getLogger(__name__)

FORMAT = 1
_KINDS = {c.__name__: c for c in (PipelineModel, StackingModel)}


def rows_digest(df: DataFrame) -> str:
    """A digest of all rows and of the schema; neither rows' nor columns' order counts, repeated rows do."""
    names = sorted(df.columns)
    cols = [F.col(f"`{c}`") for c in names]
    nulls = [c.isNull() for c in cols]  # the hash passes over nulls, so their places are hashed too
    sums = [F.sum(F.xxhash64(F.lit(salt), *cols, *nulls).cast("decimal(20,0)")).alias(f"s{salt}") for salt in (1, 2)]
    row = df.agg(F.count("*").alias("n"), *sums).first()
    types = [(c, df.schema[c].dataType.simpleString()) for c in names]
    return hashlib.sha256(json.dumps([types, row["n"], str(row["s1"]), str(row["s2"])]).encode()).hexdigest()


def fit_or_load(root: str, data: DataFrame, config: Mapping, fit: Callable[[DataFrame], dict[str, Model]]) -> dict[str, Model]:
    """``fit(data)``, a dict of fitted models, or what an earlier call with equal rows and an equal ``config`` saved below ``root``."""
    spark = data.sparkSession
    key = hashlib.sha256(json.dumps([FORMAT, spark.version, config, rows_digest(data)], sort_keys=True).encode()).hexdigest()
    path = f"{root}/{key}"
    if _path_exists(spark, f"{path}/done/_SUCCESS"):
        kept = spark.read.parquet(f"{path}/done").orderBy("place").collect()  # one row per model
        log.info("fitted models of %s are loaded", key[:12])
        return {r["name"]: _KINDS[r["kind"]].load(f"{path}/{r['attempt']}/{r['place']}") for r in kept}
    models, attempt = fit(data), uuid.uuid4().hex
    for place, model in enumerate(models.values()):
        model.write().save(f"{path}/{attempt}/{place}")
    rows = [(place, name, type(m).__name__, attempt) for place, (name, m) in enumerate(models.items())]
    spark.createDataFrame(rows, "place int, name string, kind string, attempt string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
    return models
