import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tabula.llm import runs
from tabula.llm.queries import QUERIES
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """All runs by comparing every shift."""
    n, found = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            smaller = any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p))
            if length >= max(least, exponent * p) and not smaller:
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequences(count):
    rng = random.Random(7)
    for _ in range(count):
        n, letters = rng.randint(0, 45), rng.choice([1, 2, 3, 8])
        out = [rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            p = rng.randint(1, n // 2)
            a = rng.randrange(n - p)
            out = [out[i] if i < a else out[a + (i - a) % p] for i in range(n)]
        yield np.array(out, np.int64)


def test_all_runs_of_random_sequences():
    for codes in sequences(800):
        words = codes.tolist()
        assert [tuple(r) for r in runs.find_runs(codes, 2, 2).tolist()] == brute(words, 2, 2), words
        lo, hi = runs.candidate_stretches(codes, np.zeros(len(codes), np.int64))
        got = [(s + a, length, p) for a, b in zip(lo, hi, strict=True) for s, length, p in runs.find_runs(codes[a : b + 1]).tolist()]
        assert got == brute(words), words


def test_extensions_and_ranks():
    for codes in sequences(60):
        if not len(codes):
            continue
        codes = np.unique(codes, return_inverse=True)[1]
        ext = runs.Extensions(codes)
        s = [*(codes + 1).tolist(), 0]
        assert sorted(range(len(s)), key=lambda i: s[i:]) == np.argsort(ext.rank).tolist()
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j, strict=True)]
        assert ext(i, j).tolist() == want


@pytest.mark.parametrize("n", [1, 15, 16, 17, 100, 1000])
def test_range_minimum(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(np.int32)
    a, b = np.sort(rng.integers(0, n, (2, 500)), 0)
    assert runs.RangeMinimum(values)(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]


def test_odd_texts(spark):
    line = "the same line of words "
    texts = [None, "", " \n\t", "a", "x " * 5, "x " * 6, "x\x0bx\x0cx\rx\tx\nx", "ab ab AB ab ab ab", "é " * 7 + "ü é " * 8, line * 4, line * 4 + "the", "z " + line * 9 + "a b", "a a a b " * 6, "one two " * 30_000]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, "y " * 9, "c", "c"), (9, line * 4, "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")
    for r in runs.periodic_runs(docs).collect():
        text = "y " * 9 if r.doc_id is None else texts[r.doc_id]
        words = WORD.findall(text or "")
        want = [(0, 60_000, 2)] if len(words) > 50_000 else brute(words)
        assert [tuple(x) for x in r.runs] == want, r.doc_id
        assert r.collapsed == collapsed(words, want)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()}
    docs = {r.doc_id: r.text for r in documents.collect()}
    assert set(got) == set(docs)
    planted = 0
    for i, text in docs.items():
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if n > 1200:
            continue  # too long for brute force
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            planted += 1
        want, r = brute(words), got[i]
        assert r.n_runs == len(want)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert planted > 5
