"""Periodic run detection: maximal repetitions of words by longest common extensions.

A run is a stretch of words with smallest period q that repeats often enough and can't be
extended. Every run holds a Lyndon root: the longest Lyndon word that starts at one of its
positions, for the order of words or its inverse. So each position gives two candidate
periods, read off the next smaller and the next greater suffix; each candidate is extended
to both sides by the longest common extensions of its two ends. The extensions come from
suffix trees (Ukkonen) of the words and of their reversal: the lowest common ancestor of
two leaves is the least string depth on the Euler tour between them, answered in constant
time from block minima and a sparse table.

The trees take some hundred bytes a word, so they're built where a run can lie at all:
an exact test of word trigrams, made for whole slices of documents at once, rules out the
rest. A document that is one repetition gets the trees of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.llm import textbytes as tb

MIN_LENGTH = 6
MIN_EXPONENT = 4
"""A run has at least MIN_LENGTH words and MIN_EXPONENT periods."""
BLOCK = 16
ROUNDS = 8
"""Rounds of the trigram test; more would leave fewer words to the trees, with the same runs."""
GRAM = 3

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def _tree(s: list[int], symbols: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Ukkonen's suffix tree of ``s``, whose last symbol is unique: start and end of each node's
    edge (a leaf's end is len(s)), and its edges' keys (node * symbols + first symbol, sorted) and targets."""
    n = len(s)
    start, end, link = [0], [0], [0]
    edges: dict[int, int] = {}
    node = length = left = 0
    edge = 0
    for i, c in enumerate(s):
        last = 0
        left += 1
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            to = edges.get(key)
            if to is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                low = start[to]
                span = end[to] - low
                if span > i - low:
                    span = i + 1 - low
                if length >= span:
                    edge += span
                    length -= span
                    node = to
                    continue
                if s[low + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                mid = len(start)
                start += (low, i)
                end += (low + length, n)
                link += (0, 0)
                edges[key] = mid
                edges[mid * symbols + c] = mid + 1
                start[to] = low + length
                edges[mid * symbols + s[low + length]] = to
                if last:
                    link[last] = mid
                last = mid
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    return start, end, keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]


def _tour(s: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree's Euler tour in symbol order: string depth at each visit, each suffix's
    place in the tour, and its rank among the suffixes."""
    start, end, keys, child = _tree(s, symbols)
    n = len(s)
    bounds = np.searchsorted(keys, np.arange(len(start) + 1) * symbols).tolist()
    child = child.tolist()
    at, depth, stack = bounds[:-1], [0] * len(start), [0]
    tour, place, order = [], [0] * n, []
    while stack:
        v = stack[-1]
        d = depth[v]
        tour.append(d)
        k = at[v]
        if k == bounds[v + 1]:
            stack.pop()
            continue
        at[v] = k + 1
        u = child[k]
        d += end[u] - start[u]
        if end[u] == n:  # a leaf
            place[n - d] = len(tour)
            order.append(n - d)
            tour.append(d)
        else:
            depth[u] = d
            stack.append(u)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return np.array(tour, np.int32), np.array(place), rank


class RangeMinimum:
    """Minimum of any range in constant time: prefix and suffix minima of blocks, and a sparse table of block minima."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        rows = self.values.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(rows, 1).reshape(-1)
        self.tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
        levels = [rows.min(1)]
        step = 1
        while 2 * step <= blocks:
            low = levels[-1].copy()
            low[: blocks - step] = np.minimum(low[: blocks - step], levels[-1][step:])
            levels.append(low)
            step *= 2
        self.table = np.stack(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from each a to b, ends included, a <= b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.tail[a], self.head[b])
        between = np.flatnonzero(last - first > 1)
        lo, hi = first[between] + 1, last[between]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out[between] = np.minimum(out[between], np.minimum(self.table[level, lo], self.table[level, hi - (1 << level)]))
        same = np.flatnonzero(first == last)
        least = self.values[a[same]]
        for k in range(1, BLOCK):
            inside = a[same] + k <= b[same]
            least = np.where(inside, np.minimum(least, self.values[np.minimum(a[same] + k, b[same])]), least)
        out[same] = least
        return out


class Extensions:
    """Longest common extensions of the suffixes of a sequence."""

    def __init__(self, codes: np.ndarray):
        """``codes``: 0 .. m - 1; a unique least symbol is put behind them."""
        symbols = int(codes.max()) + 2
        tour, self.place, self.rank = _tour([*(codes + 1).tolist(), 0], symbols)
        self.least = RangeMinimum(tour)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return self.least(np.minimum(a, b), np.maximum(a, b))


def _next_smaller(rank: list[int]) -> np.ndarray:
    """Where the next smaller value of each one lies, or the length."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of codes, by start, then period;
    ``min_exponent`` is 2 at least."""
    n = len(codes)
    if n < max(min_length, 2):
        return np.zeros((0, 3), np.int64)
    codes = np.unique(codes, return_inverse=True)[1]
    ahead, back = Extensions(codes), Extensions(codes[::-1])
    rank = ahead.rank[:n]
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next_smaller(rank.tolist()), _next_smaller((-rank).tolist())])
    i, j = i[j < n], j[j < n]  # a root that ends with the text ends there in every run, too: its run has one further left
    right = ahead(i, j).astype(np.int64)
    left = np.where(i > 0, back(n - i, n - j), 0).astype(np.int64)
    start, period = i - left, j - i
    length = j + right - start
    good = (length >= min_length) & (length >= min_exponent * period)
    return np.unique(np.stack([start[good], period[good], length[good]], 1), axis=0)[:, [0, 2, 1]]


def candidate_stretches(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of disjoint stretches, each within one row, that hold every run
    of at least MIN_LENGTH words and MIN_EXPONENT periods whole.

    In a run of length L and period q the trigrams of L - 2 - q consecutive words come again
    at most q words later, and L - 2 - q >= 3q - 2. So a trigram whose next copy is farther
    than a third of its stretch of recurring trigrams (and 2) belongs to no run; dropping it
    shortens stretches, and so on.
    """
    values, first = tb.window_hashes(tb.mix64(codes.astype(np.uint64)), row, GRAM)
    values = values ^ tb.mix64(row[first].astype(np.uint64))
    order = np.argsort(values, kind="stable")
    again = (values[order][1:] == values[order][:-1]) & (row[first[order]][1:] == row[first[order]][:-1])
    gap = np.zeros(len(codes) + 1, np.int64)
    gap[first[order[:-1][again]]] = (first[order[1:]] - first[order[:-1]])[again]
    for _ in range(ROUNDS):
        alive = gap > 0
        edge = np.diff(np.concatenate([[False], alive]).astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.zeros(len(gap), np.int64)
        size[alive] = np.repeat(hi - lo, hi - lo)
        far = alive & (3 * gap > size + 2)
        if not far.any():
            break
        gap[far] = 0
    alive = gap > 0
    edge = np.diff(np.concatenate([[False], alive]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    ends = np.cumsum(np.bincount(row)) - 1 if len(row) else np.zeros(0, np.int64)
    last = np.minimum(hi + (hi - lo + 3) // 3 + GRAM - 1, ends[row[lo]])
    if not len(lo):
        return lo, last
    reach = np.maximum.accumulate(last)
    fresh = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(lo) - 1]])]


def _slice_runs(texts: tb.Texts) -> tuple[np.ndarray, tb.Words, np.ndarray]:
    """(rows' runs: row, start, length, period), the words, and which words stay."""
    words = tb.words_of(texts)
    codes = tb.span_strings(texts.data, words.start, words.end).dictionary_encode().indices.to_numpy().astype(np.int64)
    head = np.searchsorted(words.row, np.arange(len(texts) + 1))
    found = [np.zeros((0, 4), np.int64)]
    for a, b in zip(*candidate_stretches(codes, words.row), strict=True):
        got = find_runs(codes[a : b + 1])
        if len(got):
            row = words.row[a]
            got[:, 0] += a - head[row]
            found.append(np.column_stack([np.full(len(got), row), got]))
    runs = np.concatenate(found)
    cover = np.zeros(len(codes) + 1, np.int64)
    begin = head[runs[:, 0]] + runs[:, 1]
    np.add.at(cover, begin + runs[:, 3], 1)
    np.add.at(cover, begin + runs[:, 2], -1)
    return runs, words, np.cumsum(cover[:-1]) == 0


def _joined(texts: tb.Texts, words: tb.Words, stays: np.ndarray) -> pa.Array:
    """Each row's words that stay, joined by one space."""
    row = words.row[stays]
    size = words.end[stays] - words.start[stays] + 1
    # behind each word one more byte is taken, the separator's; it becomes a space
    ends = np.cumsum(size)
    at = np.repeat(words.start[stays] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    data = np.append(texts.data, np.uint8(32))[at]
    data[ends - 1] = 32
    counts = np.bincount(row, minlength=len(texts))
    total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    full = counts > 0
    keep = np.ones(len(data), bool)
    keep[total[1:][full] - 1] = False  # no space behind the last word
    offsets = total - np.concatenate([[0], np.cumsum(full)])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data[keep])).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs``: (start, length, period) of all
    runs with at least MIN_LENGTH words and MIN_EXPONENT periods, by start, then period; runs
    may overlap and nest. ``collapsed``: the words joined by one space, without those that lie
    in a run behind its first period. A null or empty text has no runs and collapses to ''.
    Repeated rows are treated alike, null ids are kept, extra columns are ignored, an
    empty table gives no rows. Texts are never cut: one long text is worked on as a whole.
    """
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([src.schema[0], T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            for at, end, texts in tb.slices(tb.texts_of(batch.column(1))):
                runs, words, stays = _slice_runs(texts)
                offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                cells = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
                listed = pa.ListArray.from_arrays(pa.array(offsets), cells, type=pa.list_(pa.field("element", cells.type, False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), listed, _joined(texts, words, stays)], names=schema.names)

    return src.mapInArrow(run, schema)
