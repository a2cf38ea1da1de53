"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target label mapping of the reference workflow.
POSITIVE_LABEL = "p"
NEGATIVE_LABEL = "e"
LABEL_TO_INT = {"p": 1, "e": 0}
INT_TO_LABEL = {1: "p", 0: "e"}
# Fixed value: replacement marker for rare and missing categories.
MISSING_CATEGORY = "dna"
# Fixed value: a category is rare when its count is below this share of non-null rows.
RARE_SHARE = 0.01


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c: str | Column, mapping: Mapping) -> Column:
    """Exact lookup; values outside the mapping become NULL."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col(c) == F.lit(k), F.lit(v))) if expr is None else expr.when(col(c) == F.lit(k), F.lit(v))
    return expr if expr is not None else F.lit(None)


def hash_order_key(seed: int | str, c: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5 of '<seed>-<value>'."""
    return F.md5(F.concat(F.lit(f"{seed}-"), col(c).cast("string")))


def md5_uniform(*parts: str | Column) -> Column:
    """A uniform double in [0, 1) from the first 8 hex digits of md5 of the
    '-'-joined parts (reproducible in any SQL engine with md5)."""
    key = F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def log_uniform(u: Column, lo: float, hi: float) -> Column:
    import math

    return F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi / lo)))


def int_uniform(u: Column, lo: int, hi: int, step: int = 1) -> Column:
    n = (hi - lo) // step + 1
    return (F.lit(lo) + F.lit(step) * F.floor(u * F.lit(n))).cast("long")


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def backtick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def struct_min_label(scores: Sequence[Column], labels: Sequence[Column]) -> Column:
    """Label with the highest score; ties go to the smallest label."""
    pairs = [F.struct((-s).alias("neg"), lab.alias("label")) for s, lab in zip(scores, labels)]
    return F.array_min(F.array(*pairs)).getField("label")
