"""Hyper-parameter search (H1-H8).

* H1 ``sample_trials``: seeded random search. Every (study, trial, parameter)
  draws a uniform from md5, mapped into the parameter's range; the trial table
  is generated by Spark, nothing is sampled on the driver.
* H4/H5 patience: the resume scan is a sequential fold, but its state only
  changes at "new best" trials. Buckets of trial numbers are summed up as maps from the
  best they are entered with to the best they leave, the maps are passed through in order, and
  the buckets where the best changes list their steps: a fixed number of jobs, no
  study in one task, values of any sign.
* H6 ``top_trials``: ``row_number() <= k`` per study, which Spark executes
  with a partial WindowGroupLimit before the shuffle.
* H2/H3/H8: cross-validated objective and the search job over Spark ML
  learners (see :mod:`tabula.operators.learners`).
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.exprs import md5_uniform
from tabula.session import checkpointed

# The search spaces of the reference workflow, per model family.
# (kind, low, high[, step]) for numbers, ("cat", choices) for categories;
# "log" = log-uniform, "int" = integer uniform, "float" = uniform.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "ridge": {
        "alpha": ("log", 1e-3, 1000.0),
        "tol": ("log", 1e-5, 1e-1),
    },
    "randomforest": {
        "n_estimators": ("int", 50, 500),
        "max_depth": ("int", 3, 20),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 20),
        "max_features": ("cat", (None, "sqrt", "log2")),
    },
    "kneighbors": {
        "n_neighbors": ("int", 3, 50),
        "weights": ("cat", ("uniform", "distance")),
        "p": ("int", 1, 5),
    },
    "svc": {
        "C": ("log", 1e-3, 10.0),
        # of the kernels, only the linear one has a distributed solver
        "kernel": ("cat", ("linear",)),
        "gamma": ("cat", ("scale", "auto")),
        "tol": ("log", 1e-5, 1e-1),
    },
    "lgbm": {
        "n_estimators": ("int", 50, 500),
        "max_depth": ("int", 3, 20),
        "learning_rate": ("log", 1e-3, 1.0),
        "num_leaves": ("int", 15, 50),
        "min_child_weight": ("log", 1e-3, 100.0),
        "subsample": ("float", 0.1, 1.0),
        "colsample_bytree": ("float", 0.1, 1.0),
        "reg_alpha": ("log", 1e-8, 100.0),
        "reg_lambda": ("log", 1e-8, 100.0),
    },
    "xgb": {
        "n_estimators": ("int", 100, 1200, 50),
        "max_depth": ("int", 3, 20),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "gamma": ("log", 0.01, 10.0),
        "reg_alpha": ("log", 1e-8, 100.0),
        "reg_lambda": ("log", 1e-8, 100.0),
        "min_child_weight": ("log", 1.0, 100.0),
    },
    "catboost": {
        "iterations": ("int", 100, 1000),
        "depth": ("int", 4, 16),
        "learning_rate": ("log", 1e-3, 1.0),
        "l2_leaf_reg": ("log", 1e-3, 10.0),
        "bagging_temperature": ("float", 0.0, 1.0),
        "border_count": ("int", 32, 255),
        "scale_pos_weight": ("float", 0.0, 10.0),
        "random_strength": ("float", 0.0, 10.0),
        "one_hot_max_size": ("int", 2, 10),
        "rsm": ("float", 0.5, 1.0),
        "od_type": ("cat", ("IncToDec", "Iter")),
        "od_wait": ("int", 10, 50),
    },
    "adaboost": {
        "n_estimators": ("int", 50, 500),
        "learning_rate": ("log", 1e-3, 1.0),
    },
}
# Fixed value: dispatch order by model-name substring.
DISPATCH_ORDER = ("ridge", "randomforest", "kneighbors", "svc", "lgbm", "xgb", "catboost", "adaboost")


def space_for(model_name: str) -> str:
    """Search-space key for a model name (first substring match), else error."""
    low = model_name.lower()
    for key in DISPATCH_ORDER:
        if key in low:
            return key
    raise ValueError(f"no search space for model {model_name!r}")


def _param_value(u: Column, spec: tuple) -> tuple[Column, Column]:
    kind = spec[0]
    if kind == "log":
        lo, hi = spec[1], spec[2]
        return F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi / lo))), F.lit(None).cast("string")
    if kind == "float":
        lo, hi = spec[1], spec[2]
        return F.lit(float(lo)) + u * F.lit(float(hi - lo)), F.lit(None).cast("string")
    if kind == "int":
        lo, hi = spec[1], spec[2]
        step = spec[3] if len(spec) > 3 else 1
        n = (hi - lo) // step + 1
        return (F.lit(lo) + F.lit(step) * F.floor(u * F.lit(n))).cast("double"), F.lit(None).cast("string")
    choices = spec[1]
    arr = F.array(*[F.lit(c if c is not None else "None") for c in choices])
    return F.lit(None).cast("double"), F.element_at(arr, (F.floor(u * F.lit(len(choices))) + 1).cast("int"))


UNIFORMS_PER_HASH = 4  # an md5 has 32 hex digits = four 8-digit uniforms


def trial_uniform(hash_col: Column, slot: int) -> Column:
    """Uniform in [0, 1) from the ``slot``-th 8 hex digits of an md5 column."""
    return F.conv(F.substring(hash_col, 1 + 8 * slot, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_trials(trial_keys: DataFrame, models: Sequence[str], seed: int = 42) -> DataFrame:
    """H1: parameters for every ``(study, number)`` row of ``trial_keys`` under
    each model's space: ``(study, number, model, param, value, choice)``.

    Parameter ``j`` of model ``m`` reads slot ``j % 4`` of
    ``md5('<seed>-<study>-<number>-<m>-<j // 4>')``."""
    hashes, parts = {}, []
    for m in models:
        for j, (param, spec) in enumerate(SEARCH_SPACES[space_for(m)].items()):
            key = (m, j // UNIFORMS_PER_HASH)
            if key not in hashes:
                hashes[key] = f"__h{len(hashes)}"
            u = trial_uniform(F.col(hashes[key]), j % UNIFORMS_PER_HASH)
            val, choice = _param_value(u, spec)
            parts.append(F.struct(F.lit(m).alias("model"), F.lit(param).alias("param"), val.alias("value"), choice.alias("choice")))
    hcols = [
        F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("study"), F.col("number").cast("string"), F.lit(m), F.lit(str(g)))).alias(name)
        for (m, g), name in hashes.items()
    ]
    return trial_keys.select("study", "number", *hcols).select("study", "number", F.explode(F.array(*parts)).alias("p")).select(
        "study", "number", "p.model", "p.param", "p.value", "p.choice"
    )


def improves(value: float | None, best: float | None, min_improvement: float, direction: str = "maximize") -> bool:
    """Whether a finished trial's value is a new best; a failed trial never is."""
    if value is None or best is None:
        return value is not None
    return value > best * (1.0 + min_improvement) if direction == "maximize" else value < best * (1.0 - min_improvement)


RECORD_BUCKET_ROWS = 1_000_000


def running_records(trials: DataFrame, direction: str = "maximize", bucket_rows: int = RECORD_BUCKET_ROWS) -> DataFrame:
    """Trials whose value beats every earlier value of their study (running
    max, or min when minimising), without a per-study window: trial numbers are
    cut into fixed-size buckets, each bucket gets a local running extreme, and
    a prefix extreme over the (small) per-bucket table supplies the part before
    the bucket. A study holding most rows is spread over many buckets."""
    better = F.greatest if direction == "maximize" else F.least
    agg = F.max if direction == "maximize" else F.min
    t = trials.where(F.col("value").isNotNull()).select("study", "number", "value").withColumn(
        "__b", F.floor(F.col("number") / F.lit(bucket_rows)).cast("long")
    )
    w_local = Window.partitionBy("study", "__b").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    local = t.withColumn("__prev_local", agg("value").over(w_local))
    per_bucket = t.groupBy("study", "__b").agg(agg("value").alias("__bx"))
    w_pre = Window.partitionBy("study").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.withColumn("__prev_bucket", agg("__bx").over(w_pre)).select(
        F.col("study").alias("__s"), F.col("__b").alias("__pb"), "__prev_bucket"
    )
    j = local.join(prefix, (F.col("study") == F.col("__s")) & (F.col("__b") == F.col("__pb")))
    prev = better(F.col("__prev_local"), F.col("__prev_bucket"))  # NULLs ignored
    beats = (F.col("value") > prev) if direction == "maximize" else (F.col("value") < prev)
    return j.where(prev.isNull() | beats).select("study", "number", "value")


CHAIN_BUCKET = 100_000
"""Trial numbers of one bucket."""


def _beaten_by(values: Sequence[float], factor: float) -> tuple[list[int], list[int]]:
    """For each place the first later one whose value is above ``factor`` times its own (-1: none),
    and the places of the running maxima, first to last. One pass from the end, with
    the running maxima of what follows as a stack."""
    places: list[int] = []
    keys: list[float] = []  # negated values of ``places``, ascending
    after = [-1] * len(values)
    for i in range(len(values) - 1, -1, -1):
        k = bisect_left(keys, -(values[i] * factor))
        if k:
            after[i] = places[k - 1]
        while keys and keys[-1] >= -values[i]:
            keys.pop()
            places.pop()
        keys.append(-values[i])
        places.append(i)
    return after, places[::-1]


def _summary(values: Sequence[float], factor: float) -> tuple[list[float], list[float]]:
    """What a bucket does to any best value it is entered with: (tops, exits), both by place.

    A best whose bar is below ``tops[k]``, but not below ``tops[k - 1]``, leaves as
    ``exits[k]``; one whose bar no top exceeds leaves as it came. The first value above a bar is
    a running maximum, and from there the way is fixed; maxima that leave alike are one entry.
    """
    after, maxima = _beaten_by(values, factor)
    end = list(range(len(values)))
    for i in range(len(values) - 1, -1, -1):
        if after[i] >= 0:
            end[i] = end[after[i]]
    tops: list[float] = []
    exits: list[int] = []
    for i in maxima:
        if exits and exits[-1] == end[i]:
            tops[-1] = values[i]
        else:
            tops.append(values[i])
            exits.append(end[i])
    return tops, [values[i] for i in exits]


def best_chain(trials: DataFrame, min_improvement: float, direction: str = "maximize", batch: int = CHAIN_BUCKET) -> DataFrame:
    """All "new best" trials per study, in order: ``(study, step, number, value)``.

    Step 0 is the first trial with a value; step i+1 is the first later trial whose value
    beats step i by more than ``min_improvement``. Values may have any sign. Trial numbers are cut
    into buckets of ``batch``, a study of any size into many: every bucket is summed up by
    :func:`_summary`, the summaries of a study are passed through in order, one at a time (what a
    task holds is one batch of them), and the buckets where the best changes list their
    steps. NaN never is a new best. The number of jobs depends on nothing in the data.
    """
    sign = 1.0 if direction == "maximize" else -1.0
    factor = 1.0 + sign * min_improvement
    usable = F.col("value").isNotNull() & ~F.isnan("value")
    t = trials.where(usable).select("study", F.col("number").cast("long").alias("number"), (F.col("value").cast("double") * F.lit(sign)).alias("w"))
    t = t.withColumn("bucket", F.floor(F.col("number") / F.lit(batch)).cast("long"))
    key = t.select("study").schema["study"].dataType.simpleString()

    def summed(own: pd.DataFrame) -> pd.DataFrame:
        tops, exits = _summary(own.sort_values(["number", "w"])["w"].tolist(), factor)
        return pd.DataFrame({"study": own["study"].iloc[:1].tolist(), "bucket": own["bucket"].iloc[:1].tolist(), "tops": [tops], "exits": [exits]})

    def entered(batches):
        study, best = None, None
        for batch in batches:
            rows = []
            for s, b, tops, exits in zip(batch["study"].tolist(), batch["bucket"], batch["tops"], batch["exits"], strict=True):
                if s != study:
                    study, best = s, None
                k = 0 if best is None else bisect_right(tops, best * factor)
                if k < len(tops):
                    rows.append((s, b, best))
                    best = float(exits[k])
            yield pd.DataFrame(rows, columns=["study", "bucket", "entry"]).astype({"bucket": "int64", "entry": "float64"})

    def steps(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["number", "w"])
        entry, rows = own["entry"].iloc[0], []
        best = None if pd.isna(entry) else entry
        for at, w in enumerate(own["w"].tolist()):
            if best is None or w > best * factor:
                best = w
                rows.append(at)
        out = own.iloc[rows]
        return pd.DataFrame({"study": out["study"], "bucket": out["bucket"], "place": range(len(rows)), "number": out["number"], "w": out["w"]})

    folder = t.groupBy("study", "bucket").applyInPandas(summed, f"study {key}, bucket long, tops array<double>, exits array<double>")
    ordered = folder.repartition("study").sortWithinPartitions("study", "bucket")
    entries = checkpointed(ordered.mapInPandas(entered, f"study {key}, bucket long, entry double"))
    listed = t.join(entries, ["study", "bucket"]).groupBy("study", "bucket").applyInPandas(steps, f"study {key}, bucket long, place long, number long, w double")
    listed = checkpointed(listed)
    # one row per bucket with a step
    sizes = listed.groupBy("study", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("study").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("study", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return listed.join(offsets, ["study", "bucket"]).select("study", (F.col("before") + F.col("place")).cast("int").alias("step"), "number", (F.col("w") * F.lit(sign)).alias("value"))


def patience_state(trials: DataFrame, min_improvement: float, direction: str = "maximize") -> DataFrame:
    """H4: ``(study, best_value, no_improvement_count)`` after scanning all
    existing trials (failed / valueless trials leave the state unchanged)."""
    chain = best_chain(trials, min_improvement, direction)
    last = chain.groupBy("study").agg(F.max(F.struct("step", "number", "value")).alias("s")).select(
        "study", F.col("s.number").alias("__pos"), F.col("s.value").alias("best_value")
    )
    studies = trials.select("study").distinct()
    counted = (
        trials.where(F.col("value").isNotNull())
        .join(last, "study")
        .where(F.col("number") > F.col("__pos"))
        .groupBy("study")
        .agg(F.count(F.lit(1)).alias("__after"))
    )
    return (
        studies.join(last, "study", "left")
        .join(counted, "study", "left")
        .select("study", "best_value", F.coalesce(F.col("__after"), F.lit(0)).cast("long").alias("no_improvement_count"))
    )


def early_stop_point(trials: DataFrame, patience: int, min_improvement: float, direction: str = "maximize") -> DataFrame:
    """H5: the trial number at which the early-stopping rule (``patience``
    consecutive trials without a qualifying improvement of the study's best)
    would have stopped each study; NULL if it never triggers."""
    chain = best_chain(trials, min_improvement, direction)
    w = Window.partitionBy("study").orderBy("number")
    gaps = chain.withColumn("__next", F.lead("number").over(w))
    last_number = trials.groupBy("study").agg(F.max("number").alias("__last"), F.count(F.lit(1)).alias("n_trials"))
    cand = (
        gaps.join(last_number, "study")
        .withColumn("__stop", F.col("number") + F.lit(patience))
        .where((F.col("__stop") <= F.col("__last")) & (F.col("__next").isNull() | (F.col("__next") > F.col("__stop"))))
        .groupBy("study")
        .agg(F.min(F.struct("__stop", "value")).alias("s"))
    )
    return last_number.join(cand, "study", "left").select(
        "study",
        F.col("s.__stop").cast("long").alias("stop_number"),
        F.col("s.value").alias("best_value_at_stop"),
        F.col("n_trials").cast("long").alias("n_trials"),
    )


def top_trials(trials: DataFrame, k: int = 3, direction: str = "maximize") -> DataFrame:
    """H6: best ``k`` completed trials per study, named ``<study>_top_<i>``."""
    order = F.col("value").desc() if direction == "maximize" else F.col("value").asc()
    w = Window.partitionBy("study").orderBy(order, F.col("number").asc())
    done = trials.where((F.col("state") == "COMPLETE") & F.col("value").isNotNull())
    # filter on the raw row_number so Catalyst inserts a partial WindowGroupLimit
    ranked = done.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).withColumn("rank", F.col("__rn") - 1)
    return ranked.select(
        "study", "number", "value", F.col("rank").cast("int").alias("rank"),
        F.concat(F.col("study"), F.lit("_top_"), F.col("rank").cast("string")).alias("name"),
    )
