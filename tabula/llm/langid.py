"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1 (drawn from its code point). The vector of
a letter trigram binds its letters' vectors, permuted by their position, with a
product; a text bundles (adds) the vectors of all its trigrams, a language those of
all its training texts. A text gets the language whose prototype has the largest
cosine with the text's bundle.

Bundles are sums of integers, so any partitioning of the rows gives the same
prototypes. Training returns one bundle per language and partition; prediction
needs only the prototypes (languages x DIMENSION numbers) and no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.llm import textbytes as tb

DIMENSION = 1024
SEED = 0x1D
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
BLOCK_GRAMS = 1 << 11
"""Distinct trigrams whose vectors are held at once: a text of many different ones takes no more memory."""
BLOCK_ROWS = 1 << 10
"""Texts that are counted and compared at once: many short ones take no more memory."""
KNOWN_LETTERS = 1 << 15
DENSE = 1 << 23
"""Trigram codes below this are counted in a table, others by sorting."""

_SPACE = 32


def _letters() -> np.ndarray:
    """Lower-cased letter of every code point; the space for anything that is no letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x32400):  # no letters are assigned beyond
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTER: np.ndarray | None = None


def trigrams(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter trigrams of each row, words set apart by one space, a space in front:
    (row of each, index of each in the distinct ones, distinct (n, 3) letters, letters per row)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    n = len(texts)
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(texts.data) + 1, np.int32)  # one text is below 2 GB
    np.cumsum((texts.data & 0xC0) != 0x80, dtype=np.int32, out=ends[1:])
    starts = ends[texts.offsets].astype(np.int64)
    del ends
    low = np.insert(_LETTER[points], starts[:-1], _SPACE)  # each row begins with a space
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts) + 1)
    letter = low != _SPACE
    counts = np.bincount(row[letter], minlength=n)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, the first
    keep[starts[:-1] + np.arange(n)] = True
    low, row = low[keep], row[keep]
    if len(low) < 3:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3), np.uint32), counts
    used = np.zeros(int(low.max()) + 1, bool)
    used[low] = True
    symbols = np.flatnonzero(used).astype(np.uint32)
    m = len(symbols)
    number = np.zeros(len(used), np.int32 if m**3 <= DENSE else np.int64)
    number[symbols] = np.arange(m)
    code = number[low]
    key = (code[:-2] * m + code[1:-1]) * m + code[2:]
    inside = (row[:-2] == row[2:]) & (low[1:-1] != _SPACE)
    key, row = key[inside], row[:-2][inside]
    if m**3 <= DENSE:
        known = np.zeros(m**3, bool)
        known[key] = True
        seen = np.flatnonzero(known)
        place = np.zeros(m**3, np.int32)
        place[seen] = np.arange(len(seen), dtype=np.int32)
        index = place[key]
    else:
        seen, index = np.unique(key, return_inverse=True)
    return row, index, symbols[np.stack([seen // (m * m), seen // m % m, seen % m], 1)], counts


_VECTORS: dict[tuple[int, int, int], np.ndarray] = {}


def _letter_vector(letter: int, dimension: int, seed: int) -> np.ndarray:
    key = (seed, dimension, letter)
    if key not in _VECTORS:
        if len(_VECTORS) >= KNOWN_LETTERS:
            _VECTORS.clear()
        bits = np.random.Generator(np.random.Philox(key=(seed << 32) | letter)).integers(0, 2, dimension, dtype=np.int8)
        _VECTORS[key] = 2 * bits - 1
    return _VECTORS[key]


def gram_vectors(grams: np.ndarray, dimension: int = DIMENSION, seed: int = SEED) -> np.ndarray:
    """(n, dimension) of +-1: the bound vectors of trigrams of code points."""
    symbols, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    base = np.stack([_letter_vector(int(c), dimension, seed) for c in symbols])
    return np.roll(base, 2, 1)[at[:, 0]] * np.roll(base, 1, 1)[at[:, 1]] * base[at[:, 2]]


def bundles(rows: np.ndarray, index: np.ndarray, grams: np.ndarray, n: int, dimension: int) -> np.ndarray:
    """(n, dimension): the sum of each row's trigram vectors, a block of distinct trigrams at a time."""
    out = np.zeros((n, dimension), np.float32)
    order = np.argsort(index, kind="stable")
    rows, index = rows[order], index[order]
    for lo in range(0, len(grams), BLOCK_GRAMS):
        block = grams[lo : lo + BLOCK_GRAMS]
        a, b = np.searchsorted(index, [lo, lo + len(block)])
        at, gram, vectors = rows[a:b], index[a:b] - lo, gram_vectors(block, dimension).astype(np.float32)
        if n > BLOCK_ROWS:
            by_row = np.argsort(at, kind="stable")
            at, gram = at[by_row], gram[by_row]
        for first in range(0, n, BLOCK_ROWS):
            m = min(BLOCK_ROWS, n - first)
            c, d = np.searchsorted(at, [first, first + m]) if n > BLOCK_ROWS else (0, len(at))
            counts = np.bincount((at[c:d] - first) * len(block) + gram[c:d], minlength=m * len(block)).reshape(m, len(block))
            out[first : first + m] += counts.astype(np.float32) @ vectors
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """The prototype of each language that a row with a letter has; null languages and texts teach nothing.

    The driver gets one vector per language.
    """
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for at, end, texts in tb.slices(tb.texts_of(batch.column(0)), SLICE_BYTES):
                row, index, grams, _ = trigrams(texts)
                sums = bundles(which[at:end][row], index, grams, len(names), dimension).astype(np.float64)
                for k in np.unique(which[at:end][row]):
                    total[names[k]] = total.get(names[k], 0) + sums[k]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    parts = src.mapInArrow(tb.freeing(run), "lang string, bundle array<double>")
    cells = parts.select("lang", F.posexplode("bundle").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    got = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("cells")).select("lang", "cells.v").collect()
    return {r.lang: np.array(r.v) for r in sorted(got, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, with ``lang_pred`` and ``score``.

    ``score`` is the cosine with the chosen prototype, 0 at least. A null text or one
    without a letter, or no prototype at all, gives (``und``, 0). Equal cosines: the
    first language by name. Columns of these names in ``docs`` are replaced.
    """
    names = list(prototypes)
    dimension = len(next(iter(prototypes.values()), [0]))
    unit = np.array([v / max(np.linalg.norm(v), 1e-300) for v in prototypes.values()]).reshape(len(names), dimension).T
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    src = docs.select(*[F.col(f"`{c}`") for c in cols])
    kept = src.schema.fields
    # a text that is kept anyway isn't sent twice
    text_at = cols.index(text_col) if text_col in cols and isinstance(src.schema[text_col].dataType, T.StringType) else len(cols)
    if text_at == len(cols):
        src = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at, end, texts in tb.slices(tb.texts_of(batch.column(text_at)), SLICE_BYTES):
                row, index, grams, letters = trigrams(texts)
                vectors = bundles(row, index, grams, end - at, dimension or 1)
                best, score = np.full(end - at, -1), np.zeros(end - at)
                if names:
                    for first in range(0, end - at, BLOCK_ROWS):
                        some = slice(first, first + BLOCK_ROWS)
                        own = vectors[some].astype(np.float64)
                        cosine = (own @ unit) / np.maximum(np.sqrt((own**2).sum(1)), 1e-300)[:, None]
                        best[some] = np.where(letters[some] > 0, cosine.argmax(1), -1)
                        score[some] = np.where(best[some] >= 0, np.clip(cosine.max(1), 0, 1), 0.0)
                choice = pa.array([names[b] if b >= 0 else UNKNOWN for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, end - at) for k in range(len(cols))), choice, pa.array(score)], names=[f.name for f in schema])

    return src.mapInArrow(tb.freeing(run), schema)
