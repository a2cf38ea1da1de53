"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage reads what its predecessor wrote; all but the last return the columns
of ``documents`` with the stage's decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm import bottomk, langid, mixing, packing, pii
from tabula.llm.queries import MIX_SHARE, MIX_TARGETS, PII_KEY, mix_dimensions, tokenizer_file
from tabula.llm.scratch import stored
from tabula.operators.rowindex import with_row_index


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter) go; the predicted language replaces ``lang``.

    Without a labelled row there is nothing to predict with: the others keep their ``lang``."""
    model = langid.train(docs)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    got = langid.predict(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return got.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest id.

    Texts that share an id are judged apart; rows equal in id and text are one document."""
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = named.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__rest")).select("doc_id", "text", "__rest.*")
        nodes = stored(with_row_index(one, ["doc_id", F.xxhash64("text"), "text"], "__node"), "nodes")
        marks = bottomk.near_duplicates(nodes, id_col="__node")
        left = nodes.join(marks.where("not kept").select("__node"), "__node", "left_anti")
        return left.select(docs.columns).unionByName(docs.where("doc_id is null"))
    marks = bottomk.near_duplicates(docs)
    drop = marks.where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; ``n_chars`` follows the text."""
    got = pii.replace_entities(docs, PII_KEY, count_col="__entities")
    chars = F.when(F.col("__entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", chars).select(docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture draws."""
    return mixing.mix(docs, mix_dimensions(), MIX_TARGETS, MIX_SHARE).where("mix.drawn").select(docs.columns)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, tokenizer_file)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("surrogates", surrogates),
    ("source_mixture", source_mixture),
    ("harmonic_packing", harmonic_packing),
]

ORACLE_SQL = None
"""Hypervectors, sketches and the tokenizer aren't expressible in SQL; tests/llm has a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows lie in the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
