"""The corpus pipeline: documents in, a cleaned, mixed and sharded corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, langid, mixing, sharding
from lectern.session import materialise

SHARDS = 24


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go, texts without a letter among them.

    The model is learnt from the labelled documents. Columns stay as they are,
    the given label included.
    """
    model = langid.fit(docs)
    marked = docs.select(F.struct("*").alias("row"), langid.language(F.col("text"), model).alias("found"))
    return marked.where("found.accepted").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; wordless documents stay.

    Of rows with one id and one text, which are a group of their own, one stays.
    """
    return jaccard.representatives(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.apply(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, 0 to 23; equal texts share one."""
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Compression and scheduling by a heap have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
