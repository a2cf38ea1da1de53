"""Connected components of an undirected edge list by alternating large-star and
small-star steps: every step is an aggregate and a join keyed by node, so a hub
is pre-aggregated before its shuffle and no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.scratch import stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Null ends and loops are no edges. Repeated edges count once. Nodes without an
    edge aren't returned.
    """
    star = stored(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # large star: hang every larger neighbour (and the node) on the least one
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(_least(both).withColumn("m", F.least("m", "u")), "u")
        large = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every smaller neighbour (and the node) hangs on the least of them
        low = large.join(_least(large), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        star = stored(small.where("u > v").distinct(), "star")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # at the fixed point every edge hangs on its component's least node
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
