"""The index in hash partitions: a sync costs what changed, not what is stored.

A row lies in the partition that a hash of its URL gives, so that all chunks of
a document lie together, beside a digest of what it was made from. A sync

1. reads keys and digests only, two of the table's columns, and compares them
   with those of the chunks;
2. embeds the chunks that are new or changed;
3. writes the partitions that hold a change anew, by Spark's dynamic partition
   overwrite. Files of all other partitions stay as they are.

Each partition is replaced as a whole and carries its own digests. A sync that
ends half way leaves some partitions new and some old; running it again finds
the rest and ends in the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INDEX
from ..session import materialise
from .embedding import DIM, embed, model_name
from .index import require_unique
from .models import model_stage

#: A partition is written by one task, so 256 MB are enough for one; the fewer documents it holds, the fewer are written again
#: with one that has changed. The number is fixed at creation.
BUCKETS = 256
_MADE_FROM = ("url", "page_title", "text", "model")
_STORED = T.StructType([*INDEX.fields, T.StructField("digest", T.StringType()), T.StructField("bucket", T.IntegerType())])


def bucket_of(key: Column, buckets: int) -> Column:
    """The first 32 bits of the key's MD5 modulo ``buckets``."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """All rows with their digests; each written partition also has a row without a key, so that none is empty."""
    return spark.read.schema(_STORED).parquet(f"{root}/rows").where("chunk_id IS NOT NULL")


def buckets_of(spark: SparkSession, root: str) -> int | None:
    """The number of partitions of the index below ``root``, None if there is no index."""
    try:
        return spark.read.schema("buckets int").parquet(f"{root}/layout").first().buckets
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The index; chunks that the encoder gave no vector are not part of it."""
    if buckets_of(spark, root) is None:
        raise FileNotFoundError(f"no index below {root}")
    return _stored(spark, root).where("embedding IS NOT NULL").select(*INDEX.fieldNames())


def _write(rows: DataFrame, root: str, written: list[int], how: str) -> None:
    spark = rows.sparkSession
    marks = spark.createDataFrame([(b,) for b in written], "bucket int")
    every = rows.select(*_STORED.fieldNames()).unionByName(marks, allowMissingColumns=True)
    # a task writes the whole of a partition, so it is one file
    every.repartition(max(1, len(written)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(
        "bucket"
    ).parquet(f"{root}/rows")


@dataclass
class Sync:
    """``changes``: chunk_id, bucket, change_type. ``written``: the partitions that hold one of them."""

    changes: DataFrame
    written: list[int]
    buckets: int


def sync_store(
    spark: SparkSession,
    root: str,
    chunks: DataFrame,
    dim: int = DIM,
    encoder=None,
    model: str | None = None,
    buckets: int = BUCKETS,
) -> Sync:
    """Bring the index below ``root`` in step with ``chunks``; create it if there is none.

    ``chunks`` has one row per ``chunk_id`` and is read up to three times, so
    it should be a table. Chunks embedded by another model count as changed.
    Readers that opened the index before may miss files of rewritten
    partitions, as with any table that is overwritten.
    """
    require_unique(chunks, "chunk_id")
    tag = model or model_name(dim)
    known = buckets_of(spark, root)
    buckets = known or buckets
    has_vector = chunks.where(F.lower("text").rlike("[a-z0-9]")) if encoder is None else chunks
    rows = has_vector.select("chunk_id", "url", "page_title", "text", F.lit(tag).alias("model"))
    rows = rows.withColumn("digest", F.md5(F.to_json(F.struct(*_MADE_FROM), {"ignoreNullFields": "false"})))
    rows = rows.withColumn("bucket", bucket_of(F.col("url"), buckets))

    wanted = rows.select("chunk_id", "bucket", F.col("digest").alias("new"), F.lit(None).cast("string").alias("old"))
    if known is not None:
        held = _stored(spark, root).select("chunk_id", "bucket", F.lit(None).cast("string").alias("new"), F.col("digest").alias("old"))
        wanted = wanted.unionByName(held)
    sides = wanted.groupBy("chunk_id", "bucket").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("new") != F.col("old"), "update")
    changes = materialise(sides.select("chunk_id", "bucket", kind.alias("change_type")).where("change_type IS NOT NULL"), "changes")
    # at most as many numbers as the index has partitions
    written = sorted(r.bucket for r in changes.select("bucket").distinct().collect())

    stale = rows.join(changes.where("change_type <> 'delete'").select("chunk_id"), "chunk_id", "left_semi")
    if encoder is None:
        fresh = embed(stale, "text", dim, model=tag)
    else:
        fresh = model_stage(stale, encoder, "text", "embedding", "array<float>")
    if known is None:
        every = list(range(buckets))
        _write(fresh, root, every, "static")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")
        return Sync(changes, every, buckets)
    if written:
        kept = _stored(spark, root).where(F.col("bucket").isin(written)).join(changes.select("chunk_id"), "chunk_id", "left_anti")
        _write(kept.unionByName(fresh.select(*_STORED.fieldNames())), root, written, "dynamic")
    return Sync(changes, written, buckets)


def sync_cost(spark: SparkSession, root: str, sync: Sync) -> DataFrame:
    """``(n_buckets, n_written, n_rows, n_changed, n_rewritten)``: what a sync wrote of what is stored."""
    stored = _stored(spark, root)
    n = {"n_buckets": sync.buckets, "n_written": len(sync.written)}
    rewritten = F.count_if(F.col("bucket").isin(sync.written)) if sync.written else F.lit(0).cast("long")
    changed = sync.changes.agg(F.count("*").alias("n_changed"))
    return stored.agg(F.count("*").alias("n_rows"), rewritten.alias("n_rewritten")).join(changed).select(
        *[F.lit(v).alias(k) for k, v in n.items()], "n_rows", "n_changed", "n_rewritten"
    )
