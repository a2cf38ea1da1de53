"""Vectorised word arithmetic on Arrow string buffers.

An Arrow batch holds its texts as one UTF-8 byte buffer plus offsets, so words,
shingles and windows of thousands of documents are found with a few numpy passes
and no per-document Python. A word is ``[^\\x20\\x09-\\x0D]+``; all separators are
ASCII, so working on bytes never cuts a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import wraps

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 4 << 20
"""Texts are worked on in slices of about this size (one longer text is its own
slice): numpy's temporaries are a small multiple of it."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
HASH_SPAN = 1 << 20


@dataclass(frozen=True)
class Texts:
    """Byte buffer, offsets (rows + 1) and validity of a slice of texts."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass(frozen=True)
class Words:
    """Start and end byte of every word and the row it lies in (ascending)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The buffers of an Arrow string column; null texts are empty and not valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    valid = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = int(off[0]), int(off[-1])
    off = off - first
    if column.null_count:  # a null may still span bytes
        lengths = np.diff(off) * valid
        if lengths.sum() != off[-1]:
            return replace(texts_of(column.fill_null("")), valid=valid)
    return Texts(buf[first:last], off, valid)


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive runs of rows of about ``limit`` bytes: (first row, end row, texts)."""
    n, at = len(texts), 0
    while at < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        lo, hi = texts.offsets[at], texts.offsets[end]
        yield at, end, Texts(texts.data[lo:hi], texts.offsets[at : end + 1] - lo, texts.valid[at:end])
        at = end


def give_back() -> None:
    """The memory that this process has freed goes back to the system: Arrow's pool and the C library
    keep it otherwise, and Spark's idle workers with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a mapInArrow, with ``give_back`` at its end: the worker is used again, and a later
    task or the JVM beside it needs the room."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def words_of(texts: Texts, separator: np.ndarray = SEPARATOR) -> Words:
    """The runs of bytes that ``separator`` (a flag per byte value) doesn't mark."""
    return spans_of(~separator[texts.data], texts.offsets)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of marked bytes; a run ends with its row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(start, np.flatnonzero(inside & ~after) + 1, row_of(offsets, start))


def span_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans (disjoint, ascending) as an Arrow string column."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    taken = np.zeros(len(data) + 1, np.int8)
    taken[start] += 1
    taken[end] -= 1
    kept = data[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept)))


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (disjoint, ascending): a polynomial from
    prefix sums, mixed with the length. Works over runs of HASH_SPAN bytes."""
    out = np.empty(len(start), np.uint64)
    at = 0
    longest = int((end - start).max(initial=0))
    span = min(max(HASH_SPAN, longest), int(end[-1] - start[0])) if len(start) else 0
    up, down = (_powers(b, span + 1) for b in (_BASE, _BASE_INV)) if len(start) else (None, None)
    while at < len(start):
        lo = start[at]
        to = max(int(np.searchsorted(end, lo + span, "right")), at + 1)
        piece = data[lo : end[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


_ODD = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5, 0x8CB92BA72F3D8DD7, 0xDABA0B6EB09322E3], np.uint64)


def window_hashes(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words of one row, and their first word's index."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total += mix64(words[first + k] * _ODD[k % len(_ODD)] + np.uint64(k))
    return mix64(total), first


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's number of them."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
