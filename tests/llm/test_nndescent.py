import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabula.llm import nndescent as nn
from tabula.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def brute(rows, threshold=nn.THRESHOLD):
    """{id: (links, component)} of rows (id, vector, label), all pairs in double precision."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            if p is not None and p == q and fine(x) and fine(y) and len(x) == len(y):
                u, v = (np.asarray(w, np.float64) / np.abs(w).max() for w in (x, y))
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    s, t = find(a), find(b)
                    parent[max(s, t)] = min(s, t)
    return {k: (links[k], find(k)) for k in parent}


def made(n, seed, dim=32):
    """Clusters from two to dozens of near vectors, copies, and lone vectors."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.standard_normal(dim)
        for _ in range(int(rng.choice([1, 1, 1, 2, 3, 40]))):
            v = centre + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2])
            out.append(v.astype(np.float32).tolist())
    return [(k, v, int(rng.integers(0, 3)) if k % 7 else 0) for k, v in enumerate(out[:n])]


def test_against_all_pairs(spark):
    rows = made(700, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn.near_duplicates(df).collect()}
    assert got == want and max(w[0] for w in want.values()) > nn.NEIGHBOURS


def test_large_component_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for k in range(150)]
    points = spark.createDataFrame(rows, "id long, vec array<float>, label int").withColumn("copies", F.lit(1).cast("long"))
    found = spark.createDataFrame([(k, 0) for k in range(150)], "node long, component long")
    got = {r.id: r.links for r in nn.link_counts(points, found, nn.THRESHOLD, block=20).collect()}
    assert got == {k: v[0] for k, v in brute(rows).items()}


def near_pair(rng, cosine, dim):
    """Two unit vectors of the given cosine."""
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_dense_groups_with_links_between_them(spark):
    # every point has more than 8 closer neighbours in its own group, so no list holds a link of both groups
    rng = np.random.default_rng(5)
    rows = []
    for label, sizes in ((1, (40, 40)), (2, (1500, 60))):
        for centre, n in zip(near_pair(rng, 0.95, 64), sizes):
            rows += [(len(rows) + k, (centre + 0.002 * rng.standard_normal(64)).tolist(), label) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn.near_duplicates(df).collect()}
    assert {k: got[k] for k in range(80)} == dict.fromkeys(range(80), (79, 0))
    assert {k: got[k] for k in range(80, 1640)} == dict.fromkeys(range(80, 1640), (1559, 80))


def test_links_across_blocks(spark):
    rng = np.random.default_rng(6)
    a, b = near_pair(rng, 0.95, 16)
    rows = [(k, (centre + 0.002 * rng.standard_normal(16)).tolist(), 1, k % 2) for k, centre in enumerate([a, b] * 60)]
    points = spark.createDataFrame(rows, "id long, vec array<double>, label int, component long")
    got = nn.across(points, points, nn.THRESHOLD, block=25).groupBy(F.col("dst").isNull().alias("counts")).agg(F.sum("hits").alias("hits"), F.sum("same").alias("same"), F.count("*").alias("n")).collect()
    count = next(r for r in got if r.counts)
    assert (count.hits, count.same) == (120 * 119, 120 * 59)
    assert next(r for r in got if not r.counts).n <= 25  # one for each pair of blocks


def test_audit_sees_a_missing_link(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (3, [0.01, 1.0], 1)]
    points = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    none = spark.createDataFrame([(2, 2), (3, 2)], "node long, component long")
    assert nn.audit(points, none, 0.93) == 0.5
    assert nn.audit(points.limit(0), none, 0.93) == 1.0


def test_audit_goes_on_until_links_were_seen(spark):
    # 5 % of the points have a link, none of them found: any 20 points hold too few to tell
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(32).tolist(), 1) for k in range(400)]
    rows += [(400 + k, [x + 1e-3 for x in rows[k][1]], 1) for k in range(10)]
    points = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    none = spark.createDataFrame([], "node long, component long")
    recall, missed, every = nn.checked(points, none, 0.93, sample=20, least=10)
    assert recall == 0 and 5 <= len({frozenset(r) for r in missed.collect()}) <= 10
    recall, missed, every = nn.checked(points, none, 0.93, sample=20, least=1000)
    assert every and {frozenset(r) for r in missed.collect()} == {frozenset((k, 400 + k)) for k in range(10)}


def test_rare_links_of_one_large_label(spark):
    # 50,000 vectors of one label, 1 % of them with a partner at cosine 0.932 to 0.95
    rng = np.random.default_rng(9)
    x = rng.standard_normal((50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(500):
        z = rng.standard_normal(64)
        z -= (z @ x[k]) * x[k]
        c = rng.uniform(0.932, 0.95)
        x[25_000 + k] = c * x[k] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    at = rng.permutation(50_000)
    table = pa.table({"vec_id": at, "embedding": pa.array(list(x), pa.list_(pa.float64())), "label": np.ones(50_000, np.int32)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn.near_duplicates(spark.createDataFrame(table)).where("n_links > 0").collect()}
    want = {}
    for lo in range(0, 50_000, 2_000):
        for i, j in zip(*np.nonzero(x[lo : lo + 2_000] @ x.T >= nn.THRESHOLD)):
            if lo + i != j:
                want[int(at[lo + i])] = (1, int(min(at[lo + i], at[j])))
    assert got == want and len(want) == 1000


def test_longer_codes_get_more_trees():
    agree = 1 - np.arccos(nn.THRESHOLD) / np.pi
    for bits in (0, 1, 5, 10, 20):
        trees = nn.trees_for(bits)
        assert trees >= nn.TREES and (1 - agree**bits) ** trees <= nn.MISS


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], 1), (13, [1.0], 1), (14, [1e300, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [-0.0, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("x")).withColumn("copies", F.lit(5))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn.near_duplicates(df).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute(rows).items()} and got[9] == (3, 9, True)
    assert nn.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op6_nn_descent"])
def test_query(spark, name):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = QUERIES[name](spark, SF_SMALL).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
