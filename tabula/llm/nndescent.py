"""Near-duplicate embeddings of equal label by NN-descent.

1. Equal vectors collapse into one point, so copies cost nothing.
2. A forest of random hyperplanes gives first neighbours: points of equal sign
   code share a leaf; large leaves are split at random. Longer codes get more trees, so that
   a pair at the threshold misses all its shared leaves with a chance of MISS at most.
3. Descent: in each point's neighbourhood (its list and its closest reverse neighbours)
   all members are compared with each other, and whoever is closer than a
   member's present neighbours enters its list. Rounds go on while links are found.
4. A list full of links is saturated: the point may have more, and links between two dense
   groups are in no list. Saturated points are compared, in blocks, with all saturated
   points of other components (the largest component of a label only with the others).
5. Audit: points are compared with every point, in growing samples until enough of them
   had links (lone and dense points don't count), or all were compared. Links that
   they miss enter the graph; if recall is too low, another forest, another descent
   and an audit of other points follow.
6. Links are counted in each whole component, compared in blocks, so counts are exact.

Vectors travel to bounded groups (leaves, neighbourhoods, blocks); a hot label, a hub
or a large component is spread over many of them. No pair is formed outside.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabula.llm.graph import components
from tabula.llm.scratch import stored

THRESHOLD = 0.93
NEIGHBOURS = 8
TREES = 6
LEAF = 64
BLOCK = 1024
TILE = 4096
BITS = 40
MISS = 0.01
AUDIT_POINTS = 4096
AUDIT_LINKED = 3000
"""Points with links that an audit must have seen: at RECALL, three of them miss one."""
RECALL = 0.999
SEED = 7
SLACK = 1e-9
"""Similarities in lists are rounded; links are confirmed in full double precision."""


def usable(embedding: Column) -> Column:
    """Vectors that can link: no null, NaN or infinite component, not all zero, not empty."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0.0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows (double) of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


log = logging.getLogger(__name__)

_EDGES = "src long, dst long, sim double"


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(np.round(sim, 9), pa.float64())})


def trees_for(bits: int, threshold: float = THRESHOLD, least: int = TREES) -> int:
    """Trees with codes of so many bits, so that a pair at the threshold shares a code in one but for a chance of MISS."""
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return least if agree >= 1 - 1e-12 else max(least, math.ceil(math.log(MISS) / math.log1p(-agree)))


def forest(points: DataFrame, trees: int, seed: int, k: int, leaf: int = LEAF, threshold: float = THRESHOLD) -> DataFrame:
    """(src, dst, sim): each point's nearest in each of its leaves; ``trees`` at least."""
    per_label = points.groupBy("label").agg(F.count("*").alias("size"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("size") / F.lit(leaf))), F.lit(0)), F.lit(BITS)).cast("int")
    sized = points.join(per_label.select("label", bits.alias("bits")), "label").select("id", "label", "bits", "vec")
    schema = T.StructType([sized.schema["id"], sized.schema["label"], T.StructField("tree", T.IntegerType()), T.StructField("code", T.LongType()), sized.schema["vec"]])

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        wanted = np.array([trees_for(b, threshold, trees) for b in range(BITS + 1)])
        for batch in batches:
            vec = batch.column(3)
            sizes = vec.value_lengths().to_numpy()
            for d in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == d))
                part = batch.take(rows)
                x = _matrix(part.column(3))
                bits = part.column(2).to_numpy()
                used = np.arange(BITS) < bits[:, None]
                for tree in range(wanted[bits].max()):
                    if (d, tree) not in planes:
                        planes[d, tree] = np.random.default_rng([seed, int(d), tree]).standard_normal((BITS, int(d)))
                    at = np.flatnonzero(tree < wanted[bits])
                    code = (((x[at] @ planes[d, tree].T > 0) & used[at]) @ (1 << np.arange(BITS, dtype=np.int64))).astype(np.int64)
                    own = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(code), tree, np.int32)), pa.array(code), own.column(3)], names=schema.names)

    coded = sized.mapInArrow(run, schema).withColumn("dim", F.size("vec"))
    key = ["label", "dim", "tree", "code"]
    parts = coded.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(2 * leaf)).alias("parts"))
    leaves = coded.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"))
        n = len(ids)
        if n < 2:
            return _edges(ids[:0], ids[:0], np.zeros(0))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        m = min(k, n - 1)
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        return _edges(np.repeat(ids, m), ids[top.ravel()], np.take_along_axis(sim, top, 1).ravel())

    return leaves.select("id", "vec", *key, "part").groupBy(*key, "part").applyInArrow(nearest, _EDGES)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each point."""
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _round(lists: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: (src, dst, sim) that are closer than src's k-th neighbour."""
    # the closest reverse neighbours; partial limits keep a hub's rows few before the shuffle
    back = lists.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    hood = lists.unionByName(back).select(F.col("src").alias("at"), F.col("dst").alias("id")).distinct()
    floor = lists.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    known = points.select("id", "vec").join(floor.withColumnRenamed("src", "id"), "id", "left").select("id", F.struct("id", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "vec").alias("m"))
    members = hood.unionByName(lists.select(F.col("src").alias("at"), F.col("src").alias("id")).distinct()).join(known, "id")
    groups = members.groupBy("at").agg(F.collect_list("m").alias("ms")).select("ms")  # 2k + 1 at most

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                sizes = part.value_lengths().to_numpy().astype(np.int64)
                flat = part.flatten()
                ids, floors = flat.field("id").to_numpy(), flat.field("floor").to_numpy()
                x = _matrix(flat.field("vec"))
                first = np.cumsum(sizes) - sizes
                a = np.repeat(np.arange(len(ids)), np.repeat(sizes, sizes))
                begin = np.repeat(first, sizes * sizes)
                b = begin + (np.arange(len(a)) - np.repeat(np.cumsum(sizes * sizes) - sizes * sizes, sizes * sizes)) % np.repeat(sizes, sizes * sizes)
                up = a < b
                a, b = a[up], b[up]
                sim = np.einsum("ij,ij->i", x[a], x[b])
                fa, fb = sim > floors[a], sim > floors[b]
                yield from _edges(np.concatenate([ids[a][fa], ids[b][fb]]), np.concatenate([ids[b][fa], ids[a][fb]]), np.concatenate([sim[fa], sim[fb]])).to_batches()

    return groups.mapInArrow(run, _EDGES)


def _links(lists: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the lists' pairs whose cosine reaches the threshold in double precision."""
    near = lists.where(F.col("sim") >= threshold - 2 * SLACK).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("sim").alias("s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    clear = near.where(F.col("s") > threshold + 2 * SLACK).select("a", "b")
    edge = near.where(F.col("s") <= threshold + 2 * SLACK)
    edge = edge.join(points.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a").join(points.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return clear.unionByName(edge.where(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")) >= threshold).select("a", "b"))


def across(left: DataFrame, right: DataFrame, threshold: float, block: int = TILE) -> DataFrame:
    """(src, dst, hits, same): links of ``left`` with ``right`` points of equal label, both given
    as (id, label, vec, component).

    Rows with a dst are links of two components, for each pair of blocks as many as join
    what its links join; rows without one hold src's number of links and how many
    of them are within its component.
    """
    key = ["label", "dim"]
    sides = {}
    for side, df in (("l", left), ("r", right)):
        df = df.withColumn("dim", F.size("vec"))
        n = df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(f"n{side}"))
        sides[side] = df, n
    counts = sides["l"][1].join(sides["r"][1], key)
    dealt = []
    for side, other in (("l", "r"), ("r", "l")):
        df = sides[side][0].join(counts, key)
        df = df.withColumn(side, F.pmod(F.xxhash64("id", F.lit("block")), F.col(f"n{side}")).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        dealt.append(df.select(*key, "l", "r", F.lit(side == "l").alias("left"), "id", "component", "vec"))

    def run(table: pa.Table) -> pa.Table:
        mine = table.column("left").to_numpy(zero_copy_only=False)
        ids, comp = (table.column(c).to_numpy() for c in ("id", "component"))
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        src, hits, same, bridges, root = [], [], [], [], {}

        def find(c):
            while (up := root.setdefault(c, c)) != c:
                root[c] = c = root.setdefault(up, up)
            return c

        if len(a) and len(b):
            x, y = _matrix(table.column("vec").take(pa.array(a))), _matrix(table.column("vec").take(pa.array(b)))
            for lo in range(0, len(a), 512):
                p = a[lo : lo + 512]
                near = (x[lo : lo + 512] @ y.T >= threshold) & (ids[p, None] != ids[b])
                own = near & (comp[p, None] == comp[b])
                linked = near.any(1)
                src.append(ids[p][linked])
                hits.append(near.sum(1)[linked])
                same.append(own.sum(1)[linked])
                i, j = np.nonzero(near & ~own)
                if len(i):
                    ends = np.sort(np.stack([comp[p[i]], comp[b[j]]], 1), 1)
                    _, at = np.unique(ends, axis=0, return_index=True)
                    for k in at:
                        s, t = find(int(ends[k, 0])), find(int(ends[k, 1]))
                        if s != t:
                            root[max(s, t)] = min(s, t)
                            bridges.append((ids[p[i[k]]], ids[b[j[k]]]))
        cat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        src, hits, same, n = cat(src), cat(hits), cat(same), len(bridges)
        none = pa.nulls(len(src), pa.int64())
        u, v = (pa.array([e[k] for e in bridges], pa.int64()) for k in (0, 1))
        return pa.table({"src": pa.concat_arrays([pa.array(src), u]), "dst": pa.concat_arrays([none, v]), "hits": pa.array(np.concatenate([hits, np.zeros(n, np.int64)])), "same": pa.array(np.concatenate([same, np.zeros(n, np.int64)]))})

    both = dealt[0].unionByName(dealt[1])
    return both.groupBy(*key, "l", "r").applyInArrow(run, "src long, dst long, hits long, same long")


def _placed(points: DataFrame, found: DataFrame) -> DataFrame:
    """Points with their component; one without a link is its own."""
    return points.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "label", "vec", F.coalesce("component", "id").alias("component"))


def checked(points: DataFrame, found: DataFrame, threshold: float, k: int = NEIGHBOURS, sample: int = AUDIT_POINTS, least: int = AUDIT_LINKED, salt: int = 0) -> tuple[float, DataFrame | None, bool]:
    """(recall, missed, all): points, in the order of a hash, are compared with all until ``least`` of
    them had links, k at most each, or none is left (all). ``recall`` is the share of the points with
    links whose links are all within one component, or that of those with k at most if it is
    smaller; ``missed`` has links (a, b) that join what all links seen join.
    """
    placed = stored(_placed(points, found), "placed")
    total, done, linked, missed = placed.count(), 0.0, np.zeros(4, np.int64), None
    place = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while done < 1 and linked[2] < least and total:
        upto = 1.0 if sample >= total else sample / total
        part = placed.where((place >= done) & (place < upto))
        seen = stored(across(part, placed, threshold), "audit")
        each = seen.where("dst is null").groupBy("src").agg(F.sum("hits").alias("hits"), F.sum("same").alias("same"))
        whole, few = F.col("hits") == F.col("same"), F.col("hits") <= k
        got = each.agg(F.count("*"), F.count_if(whole), F.count_if(few), F.count_if(few & whole)).first()
        linked += np.array(got, np.int64)
        joins = seen.where("dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        missed = joins if missed is None else missed.unionByName(joins)
        done, sample = upto, 4 * sample
    recall = min((linked[j] / linked[i] for i, j in ((0, 1), (2, 3)) if linked[i]), default=1.0)
    log.info("recall %.5f: %d of %d linked points whole (%d of %d with at most %d links), %.4f of %d points compared", recall, linked[1], linked[0], linked[3], linked[2], k, done, total)
    return float(recall), missed, done >= 1 or not total


def audit(points: DataFrame, found: DataFrame, threshold: float) -> float:
    """The measured recall of ``found``."""
    return checked(points, found, threshold)[0]


def bridges(points: DataFrame, lists: DataFrame, found: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b): links that join components of saturated points, whose lists of k hold links alone."""
    full = lists.where(F.col("sim") >= threshold - SLACK).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
    dense = _placed(points.join(full, "id", "left_semi"), found).withColumn("dim", F.size("vec"))
    sizes = dense.groupBy("label", "dim", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("label", "dim").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    dense = stored(dense.join(main, ["label", "dim"]), "dense")
    minor = dense.where(F.col("component") != F.col("main"))
    cols = ["id", "label", "vec", "component"]
    return across(minor.select(*cols), dense.select(*cols), threshold).where("dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def link_counts(points: DataFrame, found: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links): copies of other points in a point's component whose cosine reaches the threshold.

    Small components share a group; the members of a large one are dealt into blocks and every
    pair of blocks is a group.
    """
    member = points.join(found.select(F.col("node").alias("id"), "component"), "id").select("id", "vec", "copies", "component")
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    total = max(1, math.ceil(found.count() / block))
    member = member.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / F.lit(block)))
    small = member.where("blocks = 1").withColumn("unit", F.pmod(F.xxhash64("component"), F.lit(total))).withColumn("i", F.lit(-1)).withColumn("j", F.lit(-1)).withColumn("left", F.lit(True))
    large = member.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    lefts = large.withColumn("i", F.col("own")).withColumn("j", F.col("k")).withColumn("left", F.lit(True))
    rights = large.withColumn("i", F.col("k")).withColumn("j", F.col("own")).withColumn("left", F.lit(False))
    cols = ["unit", "i", "j", "left", "component", "id", "copies", "vec"]
    every = small.select(*cols).unionByName(lefts.withColumn("unit", F.col("component")).select(*cols)).unionByName(rights.withColumn("unit", F.col("component")).select(*cols))

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        ids, copies, comp = (table.column(c).to_numpy() for c in ("id", "copies", "component"))
        size = table.column("vec").combine_chunks().value_lengths().to_numpy()
        links = np.zeros(len(ids), np.int64)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = _matrix(table.column("vec").take(pa.array(rows)))
            a = np.flatnonzero(left[rows])
            b = a if left.all() else np.flatnonzero(~left[rows])
            for lo in range(0, len(a), block):
                p = a[lo : lo + block]
                near = (x[p] @ x[b].T >= threshold) & (comp[rows[p], None] == comp[rows[b]]) & (ids[rows[p], None] != ids[rows[b]])
                links[rows[p]] += near @ copies[rows[b]]
        return pa.table({"id": ids[left], "links": links[left]})

    return every.groupBy("unit", "i", "j").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def graph(points: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """(node, component) of the points that have a link."""
    lists, extra, count, grown = None, None, 0, 0
    while True:
        start = forest(points, trees, seed + grown, k, threshold=threshold)
        lists = stored(_lists(start if lists is None else start.unionByName(lists), k), "lists")
        while True:
            lists = stored(_lists(lists.unionByName(_round(lists, points, k)), k), "lists")
            now = lists.where(F.col("sim") >= threshold - SLACK).count()
            if now <= count:
                break
            count = now
        links = _links(lists, points, threshold)
        links = stored(links if extra is None else links.unionByName(extra), "links")
        found = stored(components(links), "components")
        joins = stored(bridges(points, lists, found, threshold, k), "bridges")
        if not joins.isEmpty():
            links = links.unionByName(joins)
            found = stored(components(links), "components")
        recall, missed, every = checked(points, found, threshold, k, salt=grown)
        if missed is not None and not missed.isEmpty():
            found = stored(components(links.unionByName(missed)), "components")
        if every or recall >= RECALL:
            return found
        extra = joins.unionByName(missed) if extra is None else extra.unionByName(joins).unionByName(missed)
        grown += 1


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Rows are compared only when their labels are equal and not null and their lengths are equal.
    Vectors that are null, empty, zero or hold a null, NaN or infinite component link with
    nothing, nor do rows of a null id: component_id is their id, and they are kept. Equal
    vectors are linked, whatever their number. Ids are taken to differ; rows that share
    one are taken for one node and share its fate. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("vec"))
    able = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    points = stored(able.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "points")
    found = graph(points.select("id", "label", "vec", "copies"), threshold)
    links = link_counts(points, found, threshold)
    known = points.join(links, "id", "left").join(found.select(F.col("node").alias("id"), "component").distinct(), "id", "left")
    known = known.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = able.join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
