"""The chain of new bests by bucket summaries, against the trial-by-trial rule."""

import numpy as np
import pytest

from tabula.plans import search


def by_hand(trials, m, direction):
    out, best = {}, {}
    for study, number, value in sorted((t for t in trials if t[2] is not None), key=lambda t: t[1]):
        if search.improves(value, best.get(study), m, direction):
            best[study] = value
            out.setdefault(study, []).append((number, value))
    return out


def made(rng, kind, n):
    if kind == "negative":
        return -1 - rng.random(n)
    if kind == "mixed":
        return rng.normal(size=n)
    if kind == "rising":
        return np.arange(n) / 100.0
    if kind == "falling":
        return -np.arange(n) / 100.0
    return np.round(rng.random(n), 1)  # many ties, zeros


@pytest.mark.parametrize("direction", ["maximize", "minimize"])
@pytest.mark.parametrize("m", [0.0, 0.001, 0.3])
def test_summary_passes_any_best_like_the_rule(direction, m):
    rng = np.random.default_rng(3)
    sign = 1.0 if direction == "maximize" else -1.0
    factor = 1.0 + sign * m
    for kind in ("negative", "mixed", "rising", "falling", "tied"):
        w = (sign * made(rng, kind, 60)).tolist()
        tops, exits = search._summary(w, factor)
        assert tops == sorted(set(tops)) and len(tops) == len(exits)
        for entry in [None, *rng.normal(size=40), *w[:20], 0.0, -5.0, 5.0]:
            best = entry
            for x in w:
                if best is None or x > best * factor:
                    best = x
            k = 0 if entry is None else search.bisect_right(tops, entry * factor)
            assert best == (exits[k] if k < len(tops) else entry)


def test_falling_negative_values_need_few_entries():
    # every value is a "new best" of the rule here, but all ways soon meet
    w = (-1 - np.random.default_rng(1).random(20_000) * 1e-4).tolist()
    assert len(search._summary(w, 1.001)[0]) == 1


@pytest.mark.parametrize("direction", ["maximize", "minimize"])
def test_chain_over_buckets(spark, direction):
    rng = np.random.default_rng(5)
    trials = [(kind, k, None if rng.random() < 0.1 else float(v)) for kind in ("negative", "mixed", "rising", "falling", "tied") for k, v in enumerate(made(rng, kind, 150))]
    trials += [("none", 0, None), ("late", 7_000_000_000, 0.5), ("late", 3, float("nan")), ("late", 9_000_000_000, 0.9)]
    df = spark.createDataFrame(trials, "study string, number long, value double").repartition(5)
    want = by_hand([t for t in trials if t[2] is None or t[2] == t[2]], 0.01, direction)
    got = {}
    for r in sorted(search.best_chain(df, 0.01, direction, batch=16).collect(), key=lambda r: (r.study, r.step)):
        got.setdefault(r.study, []).append((r.number, r.value))
        assert r.step == len(got[r.study]) - 1
    assert got == want
    state = {r.study: (r.best_value, r.no_improvement_count) for r in search.patience_state(df, 0.01, direction).collect()}
    assert state["none"] == (None, 0)
    for study, chain in want.items():
        later = [t for t in trials if t[0] == study and t[2] is not None and t[1] > chain[-1][0]]
        assert state[study] == (chain[-1][1], len(later))
    assert search.best_chain(df.limit(0), 0.01, direction).collect() == []
