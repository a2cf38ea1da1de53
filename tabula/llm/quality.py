"""Quality rules: base rules on text statistics, then gradient-boosted trees.

Statistics of whole texts come from vectorised passes over Arrow buffers. The
trees are trained in numpy on a bounded sample of labelled rows (TRAIN_ROWS) with
histogram splits and logistic loss; features in MONOTONE may only push the score
in their stated direction. The model is flattened into node arrays, so a batch is
scored by one gather per tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.llm import textbytes as tb
from tabula.llm.scratch import stored

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2, MIN_ROWS = 60, 4, 0.15, 64, 1.0, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_digits", "n_upper", "n_stops", "n_distinct", "n_marked")
FEATURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "line_words", "digit_share", "upper_share", "stop_share", "distinct_share", "marked_share")
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "marked_share": -1}
"""Direction in which a feature may move the probability of good quality."""


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _STOP = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(bytes(range(65, 91))), _table(b".!?")


def statistics(texts: tb.Texts) -> dict[str, np.ndarray]:
    """COUNTS of each row.

    ``word_chars``: code points in words. ``n_symbols``: characters of ``#*$%&|<>``.
    ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``:
    words in WINDOW-word windows that the text has twice or more, first ones included.
    ``n_distinct``: distinct words. ``n_marked``: words that hold a symbol.
    """
    data, n = texts.data, len(texts)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[texts.offsets])

    head = (data & 0xC0) != 0x80
    words = tb.words_of(texts)
    n_words = np.bincount(words.row, minlength=n)
    out = {"n_words": n_words, "word_chars": per_row(head & ~tb.SEPARATOR[data]), "n_symbols": per_row(_SYMBOL[data]), "n_chars": per_row(head), "n_digits": per_row(_DIGIT[data]), "n_upper": per_row(_UPPER[data]), "n_stops": per_row(_STOP[data])}

    # lines: between line feeds and row ends
    feed = np.flatnonzero(data == 10)
    starts = np.concatenate([texts.offsets[:-1], feed + 1])
    ends = np.concatenate([texts.offsets[1:], feed])
    starts.sort()
    ends.sort()
    full = ends > starts
    starts, ends = starts[full], ends[full]
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[has], ends[has]
    rows = tb.row_of(texts.offsets, starts)
    out["n_lines"] = np.bincount(rows, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(rows, tb.span_hashes(data, starts, ends), n)

    hashes = tb.span_hashes(data, words.start, words.end)
    out["n_distinct"] = _distinct(words.row, hashes, n)
    total = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_marked"] = np.bincount(words.row[total[words.end] > total[words.start]], minlength=n)
    values, first = tb.window_hashes(hashes, words.row, WINDOW)
    rows = words.row[first]
    order = np.lexsort((values, rows))
    same = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    again = first[order[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(words.row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return np.bincount(rows[fresh], minlength=n)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS) of every row; a null text counts as empty."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([src.schema[id_col], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            for at, end, texts in tb.slices(tb.texts_of(batch.column(1))):
                got = statistics(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=schema.names)

    return src.mapInArrow(run, schema)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, FEATURES) from the arrays of COUNTS."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(c["n_words"] / lines),
            c["n_digits"] / chars, c["n_upper"] / chars, c["n_stops"] / words, c["n_distinct"] / words, c["n_marked"] / words,
        ],
        1,
    )


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child. ``root``: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[every, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees of logistic loss; with ``directions[f]`` = -1 or 1 the score may only fall
    or rise with feature f. One class alone gives a constant model."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1) if n else np.zeros((0, width), int)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    root, margin = [], np.full(n, base)
    if n == 0 or y.min() == y.max():
        trees = 0

    def leaf(value: float) -> int:
        k = len(nodes["value"])
        for name, v in zip(nodes, (0, np.inf, k, k, value), strict=True):
            nodes[name].append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * MIN_ROWS:
            for f in range(width):
                if not len(cuts[f]):
                    continue
                b = binned[rows, f]
                size = len(cuts[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-gr / (hr + L2), low, high)
                gain = -(2 * gl * vl + (hl + L2) * vl**2 + 2 * gr * vr + (hr + L2) * vr**2)
                ok = (nl >= MIN_ROWS) & (nr >= MIN_ROWS) & (directions[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                v = np.clip(-gs / (hs + L2), low, high)
                won = gain[k] + 2 * gs * v + (hs + L2) * v**2
                if won > best[0]:
                    best = (won, f, k, vl[k], vr[k])
        if best[1] < 0:
            k = leaf(rate * float(np.clip(-gs / (hs + L2), low, high)))
            margin[rows] += nodes["value"][k]
            return k
        _, f, cut, vl, vr = best
        at = leaf(0.0)
        mid = (vl + vr) / 2
        goes = binned[rows, f] <= cut
        (ll, lh), (rl, rh) = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[directions[f]]
        nodes["feature"][at], nodes["threshold"][at] = f, float(cuts[f][cut])
        nodes["left"][at] = grow(rows[goes], g, h, ll, lh, level + 1)
        nodes["right"][at] = grow(rows[~goes], g, h, rl, rh, level + 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        root.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0))
    kinds = {"feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return Trees(**{k: np.array(v, kinds[k]) for k, v in nodes.items()}, root=np.array(root, np.int64), base=base, depth=depth)


def train(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the labelled rows, or on the ``rows`` of them that come first by a hash of the id.
    Null ids and labels teach nothing; an id with several labels counts once, with their mean."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("__y"))
    # a hash orders the rows; only about twice as many as are wanted reach the sort
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    share = min(1.0, 2 * rows / max(known.count(), 1))
    taken = known.where(place < int(share * (1 << 40)))
    got = counts.join(taken, id_col).orderBy(place, id_col).limit(rows).toPandas()
    x = features({c: got[c].to_numpy() for c in COUNTS}) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["__y"].to_numpy(np.float64), [MONOTONE.get(f, 0) for f in FEATURES])


def score(counts: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``document_statistics`` with ``quality_score``, the probability of good quality."""
    schema = T.StructType([*counts.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(x))], names=schema.names)

    return counts.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, COUNTS, base_failed, quality_score, kept) of every row.

    ``base_failed``: fewer than MIN_WORDS words, or over REPEAT_PERCENT % of the words lie
    in repeated windows. ``kept``: passes the base rules and the trees give at least
    ``least``. Without labels of both classes the trees are constant. Repeated rows are
    judged alike; null texts count as empty and fail; extra columns are ignored.
    """
    counts = stored(document_statistics(docs, id_col, text_col), "statistics")
    scored = score(counts, train(counts, labels, id_col))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= least))
