"""Reports over results and ensemble scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ("name", "score", "params", "model", "features", "n_trials", "metadata")


def results_report(results: DataFrame) -> DataFrame:
    """The results table with the report's column order."""
    return results.select(*RESULT_COLUMNS)


def top_vs_singles(scores: DataFrame, name_col: str = "combination", sep: str = "-") -> DataFrame:
    """R2: the best combination plus the single-model rows of its members."""
    top = scores.orderBy(F.col("score").desc(), F.col(name_col).asc()).limit(1)
    members = top.select(F.explode(F.split(F.col(name_col), sep, -1)).alias(name_col))
    singles = scores.where(~F.col(name_col).contains(sep)).join(members, name_col, "left_semi")
    return singles.select(name_col, "score").unionByName(top.select(name_col, "score"))


def params_map(params_text: str = "params"):
    """Python-dict text -> map<string,string> (quotes normalised, values as text)."""
    js = F.translate(F.col(params_text), "'", '"')
    return F.from_json(js, "map<string,string>")


def params_match(results: DataFrame, actual: DataFrame) -> DataFrame:
    """Every stored parameter of every result against the actual value in
    ``actual (name, key, value)``: ``(name, key, stored, actual, match)``."""
    stored = results.select("name", F.explode(params_map("params")).alias("key", "stored"))
    joined = stored.join(actual.withColumnRenamed("value", "actual"), ["name", "key"], "left")
    return joined.select("name", "key", "stored", "actual", (F.col("stored") == F.col("actual")).alias("match"))


def prediction_parity(inside: DataFrame, outside: DataFrame, models: Sequence[str], id_col: str = "id") -> DataFrame:
    """Per model, rows where the member's prediction inside the ensemble
    differs from the stand-alone model's (full outer join on the id)."""
    a = inside.select(id_col, *[F.col(m).alias(f"in_{m}") for m in models])
    b = outside.select(id_col, *[F.col(m).alias(f"out_{m}") for m in models])
    j = a.join(b, id_col, "full_outer")
    parts = [
        F.struct(
            F.lit(m).alias("model"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(~F.col(f"in_{m}").eqNullSafe(F.col(f"out_{m}")), 1).otherwise(0)).alias("mismatches"),
        )
        for m in models
    ]
    return j.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.model", "s.n", F.col("s.mismatches").cast("long").alias("mismatches"))
