"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). Iterative proportional fitting
rakes the cells' token weights until the marginals of all three agree with their
targets. A document is then drawn with a probability proportional to its cell's
ratio of raked to present tokens; the common factor is calibrated so that the
expected number of drawn tokens is the budget although no probability exceeds 1.

Only values named in a target have a cell of their own, all others (and nulls) of a
dimension share one. Hence there are at most (sources + 1) * (languages + 1) *
(topics + 1) cells whatever the data, and raking them is driver work of a size
that the caller's targets fix; documents are only aggregated and mapped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 200
TOLERANCE = 1e-12
REST = "*"
DIGITS = 6
"""Probabilities are rounded to so many digits, so that they don't hang on the order of a sum."""

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells (they add up to 1) whose marginals meet the targets.

    ``places[d][c]`` is cell c's value in dimension d, ``targets[d]`` that dimension's
    shares. Shares of values without any token are dealt out to the others in
    proportion. Stops when no marginal is off by more than ``tolerance``, or after
    ``rounds`` rounds (targets that contradict each other have no limit).
    """
    weight = tokens / max(tokens.sum(), 1e-300)
    if not tokens.sum():
        return weight
    wanted = []
    for place, target in zip(places, targets, strict=True):
        there = np.bincount(place, tokens, len(target)) > 0
        share = np.where(there, target, 0.0)
        wanted.append(share / share.sum() if share.sum() > 0 else there / there.sum())
    for _ in range(rounds):
        off = 0.0
        for place, target in zip(places, wanted, strict=True):
            has = np.bincount(place, weight, len(target))
            off = max(off, float(np.abs(has - target).max()))
            weight = weight * np.divide(target, has, out=np.zeros_like(target), where=has > 0)[place]
        if off <= tolerance:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probability of each cell, min(1, f * weight / tokens), with f such that the expected
    tokens are ``budget`` (all of them where the weights allow no more)."""
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    full = np.cumsum(tokens[order]) - tokens[order]  # cells before are taken whole
    left = weight[order][::-1].cumsum()[::-1]  # weight of this cell and those behind
    factor = np.divide(budget - full, left, out=np.full_like(left, np.inf), where=left > 0)
    fits = factor * ratio[order] <= 1
    f = factor[fits][0] if fits.any() else np.inf
    return np.where(ratio > 0, np.minimum(1.0, np.nan_to_num(f * ratio, nan=0.0, posinf=1.0)), 0.0)


def _place(col: Column, names: list[str]) -> Column:
    return F.when(col.cast("string").isin(names), col.cast("string")).otherwise(REST)


def probabilities(docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], share: float, tokens: Column) -> DataFrame:
    """(dimension names.., tokens, weight, probability) of each cell, a small table."""
    named = {d: list(targets[d]) for d in dimensions}
    cells = docs.select(*[_place(c, named[d]).alias(d) for d, c in dimensions.items()], tokens.alias("tokens")).groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")).collect()
    cells = sorted(cells, key=lambda r: tuple(r)[:-1])
    count = np.array([float(r.tokens) for r in cells])
    places, wanted = [], []
    for d in dimensions:
        names = [*named[d], REST]
        places.append(np.array([names.index(r[d]) for r in cells], int))
        wanted.append(np.array([*(targets[d][n] for n in named[d]), max(0.0, 1 - sum(targets[d].values()))]))
    weight = rake(count, places, wanted) if cells else count
    chance = np.round(calibrate(count, weight, share * count.sum()), DIGITS) if cells else count
    rows = [(*tuple(r)[:-1], int(r.tokens), float(w), float(p)) for r, w, p in zip(cells, weight, chance, strict=True)]
    schema = ", ".join(f"`{d}` string" for d in dimensions) + ", tokens long, weight double, probability double"
    return docs.sparkSession.createDataFrame(rows, schema)


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(
    docs: DataFrame,
    dimensions: dict[str, Column],
    targets: dict[str, dict[str, float]],
    share: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row and a struct ``mix`` of its cell's
    values, ``tokens``, ``probability`` and ``drawn``.

    ``targets[d]`` gives shares of tokens for values of dimension d; what they leave to 1
    belongs to all other values and nulls together. ``share`` of all tokens is to be drawn.
    The draw hangs on id and seed alone: repeated rows share their fate, a null id counts
    as the empty one. A document without tokens is in no share: it is drawn like others of
    its cell. An empty table gives an empty result; a column named ``mix`` is replaced.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c != "mix"]
    cells = probabilities(docs, dimensions, targets, share, token_count(F.col(text_col)))
    by_cell = cells.select(F.concat_ws("\x01", *dimensions).alias("__cell"), F.col("probability").alias("__p"))
    placed = docs.select(
        *[F.col(f"`{c}`") for c in cols],
        F.struct(*[_place(c, list(targets[d])).alias(d) for d, c in dimensions.items()]).alias("__in"),
        token_count(F.col(text_col)).alias("__tokens"),
        uniform(F.col(id_col), seed).alias("__u"),
    ).withColumn("__cell", F.concat_ws("\x01", *[F.col("__in")[d] for d in dimensions]))
    # the cells are bounded by the targets
    got = placed.join(F.broadcast(by_cell), "__cell", "left")
    p = F.coalesce(F.col("__p"), F.lit(0.0))
    return got.select(*[F.col(f"`{c}`") for c in cols], F.struct(*[F.col("__in")[d].alias(d) for d in dimensions], F.col("__tokens").alias("tokens"), p.alias("probability"), (F.col("__u") < p).alias("drawn")).alias("mix"))
