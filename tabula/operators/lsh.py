"""Approximate cosine nearest neighbours by locality-sensitive hashing (L8 at scale).

On unit vectors the Euclidean distance orders like the cosine, so the hashes are
those of ``BucketedRandomProjectionLSH``. One projection hardly separates, so
``width`` of them make one band key, and ``bands`` keys are drawn; a query meets the
references that share a whole key in any band. Every meeting is scored exactly in the
JVM and ranked; a query with fewer than ``k`` meetings is searched exactly. Rows moved are
``bands`` per query and reference, and pairs follow the buckets' sizes, instead of the
full product. :func:`lsh_recall` measures what that costs in neighbours.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.operators.learners import knn_cosine

BANDS, WIDTH = 12, 4
BUCKET = 1.0
"""Bucket length in standard deviations of a projection (1 / sqrt(dimension) on unit vectors)."""


def _unit(df: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.select(F.col(id_col).alias("id"), *keep, F.transform(v, lambda x: x / norm).alias("u"), norm.alias("__norm")).where("__norm > 0").drop("__norm")


def _keyed(df: DataFrame, model, bands: int, width: int) -> DataFrame:
    """One row per band: the band's number and key."""
    hashed = model.transform(df.withColumn("__v", array_to_vector("u")))
    keys = F.array(*[F.xxhash64(F.lit(b), *[vector_to_array(F.col("__h")[b * width + i])[0] for i in range(width)]) for b in range(bands)])
    return hashed.select(*df.columns, F.explode(keys).alias("__key"))


def knn_cosine_lsh(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "vec",
    label_col: str = "label",
    bands: int = BANDS,
    width: int = WIDTH,
    bucket: float = BUCKET,
    seed: int = 42,
) -> DataFrame:
    """``(qid, rid, sim, label, rank)`` like :func:`knn_cosine`, with most of its neighbours.

    Zero and null vectors are nobody's neighbours by their key; such a query is searched exactly."""
    meetings = lsh_candidates(queries, refs, id_col, vec_col, label_col, bands, width, bucket, seed)
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("rid").asc())
    near = meetings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    served = near.where(F.col("rank") == k).select(F.col("qid").alias(id_col))
    rest = knn_cosine(queries.join(served, id_col, "left_anti"), refs, k, id_col, vec_col, label_col)
    return near.join(served.withColumnRenamed(id_col, "qid"), "qid", "left_semi").select("qid", "rid", "sim", "label", "rank").unionByName(rest)


def lsh_candidates(queries: DataFrame, refs: DataFrame, id_col: str = "id", vec_col: str = "vec", label_col: str = "label",
                   bands: int = BANDS, width: int = WIDTH, bucket: float = BUCKET, seed: int = 42) -> DataFrame:
    """``(qid, rid, sim, label)`` of each query and the references that share a band key, once each."""
    q, r = _unit(queries, id_col, vec_col), _unit(refs, id_col, vec_col, label_col)
    first = r.select(F.size("u").alias("d")).first()
    if first is None:
        return r.select(F.lit(0).cast("long").alias("qid"), F.col("id").alias("rid"), F.lit(0.0).alias("sim"), F.col(label_col).alias("label"))
    lsh = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket / first["d"] ** 0.5, numHashTables=bands * width, seed=seed)
    model = lsh.fit(r.limit(1).withColumn("__v", array_to_vector("u")))  # the projections are random: any row tells the dimension
    left = _keyed(q, model, bands, width).select(F.col("id").alias("qid"), F.col("u").alias("qu"), "__key")
    right = _keyed(r, model, bands, width).select(F.col("id").alias("rid"), F.col(label_col).alias("label"), F.col("u").alias("ru"), "__key")
    dot = F.aggregate(F.zip_with("qu", "ru", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    met = left.join(right, "__key").select("qid", "rid", "label", dot.alias("sim"))
    return met.groupBy("qid", "rid").agg(F.first("sim").alias("sim"), F.first("label").alias("label"))


def lsh_recall(found: DataFrame, queries: DataFrame, refs: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", label_col: str = "label", share: int = 100) -> float:
    """Share of the exact neighbours that ``found`` holds, over the queries of one hash class in ``share``."""
    some = queries.where(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0)
    exact = knn_cosine(some, refs, k, id_col, vec_col, label_col).select("qid", "rid")
    got = exact.join(found.select("qid", "rid", F.lit(1).alias("hit")), ["qid", "rid"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0
