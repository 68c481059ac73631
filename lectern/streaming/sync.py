"""Triggered incremental sync as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunks import chunk_documents
from ..operators.embedding import DIM
from ..operators.index import build_index
from ..schemas import INDEX
from ..session import materialise
from ..sources.tables import spread

LOG = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_with_batch(schema)).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder)


def _latest(log: DataFrame) -> DataFrame:
    """State of each URL after its last batch."""
    newest = F.max_by(F.struct("digest", "deleted", "batch_id"), "batch_id").alias("row")
    return log.groupBy("url").agg(newest).select("url", "row.*")


def write_batch(
    spark: SparkSession, documents: DataFrame, batch_id: int, root: str, dim: int = DIM, encoder=None, model=None
) -> None:
    """Apply one batch of documents; a replay of the same batch rewrites the same folders.

    A document whose content is NULL deletes its URL. Documents seen before
    with the same title and content are skipped. Of several versions of a URL
    in the batch the last by the column ``seen`` counts, a NULL content like
    any other; where that column ties or is missing, the larger digest.
    """
    digest = F.md5(F.to_json(F.struct("page_title", "content"), {"ignoreNullFields": "false"}))
    # a batch of few files would leave most cores idle
    documents = spread(documents)
    if "seen" not in documents.columns:
        documents = documents.withColumn("seen", F.lit(0))
    rows = documents.withColumn("digest", digest).withColumn("deleted", F.col("content").isNull())
    log_path, chunk_path = f"{root}/log", f"{root}/chunks"
    # what to do is decided on URLs and digests; the texts stay where they are
    newest = F.max_by(F.struct("deleted", "digest"), F.struct("seen", "digest")).alias("row")
    todo = rows.groupBy("url").agg(newest).select("url", "row.*")
    if _exists(spark, log_path):
        earlier = _read(spark, log_path, LOG).where(F.col("batch_id") < batch_id)
        todo = todo.join(_latest(earlier).select("url", "digest"), ["url", "digest"], "left_anti")
    todo = materialise(todo, "batch")
    rows = rows.join(todo.select("url", "digest"), ["url", "digest"], "left_semi").dropDuplicates(["url", "digest"])
    live = rows.where(F.col("content").isNotNull()).select("url", "page_title", "content")
    index = build_index(chunk_documents(live), dim, encoder, model)
    index.write.mode("overwrite").parquet(f"{chunk_path}/batch_id={batch_id}")
    # the log comes last: readers follow the log, so they never see half a batch
    todo.select(*LOG.fieldNames()).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")


def sync_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    root: str,
    checkpoint: str,
    to_documents: Callable[[DataFrame], DataFrame],
    max_files: int | None = None,
    **kw,
) -> None:
    """Process the files that arrived since the last run, then stop.

    ``to_documents`` may give a column ``seen``, such as a fetch time, that
    orders the versions of a URL within a trigger; else they go by the time of
    their file and their place in it.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    documents = to_documents(reader.parquet(source))
    if "seen" not in documents.columns:
        place = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index")
        documents = documents.select("*", place.alias("seen"))
    query = (
        documents.writeStream.foreachBatch(lambda df, batch_id: write_batch(df.sparkSession, df, batch_id, root, **kw))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_stream_index(spark: SparkSession, root: str) -> DataFrame:
    """The index as of the last complete batch: the chunks of each URL's last version."""
    current = _latest(_read(spark, f"{root}/log", LOG)).where(~F.col("deleted")).select("url", "batch_id")
    chunks = _read(spark, f"{root}/chunks", INDEX)
    return chunks.join(current, ["url", "batch_id"], "left_semi").select(*INDEX.fieldNames())


def compact(spark: SparkSession, root: str, target: str) -> None:
    """A copy of the stream's index below ``target`` that holds the current state alone.

    Superseded chunks and log rows and deleted URLs stay behind. Batch numbers
    are kept, so a stream goes on with ``target`` and its old checkpoint;
    ``root`` can go when no reader needs it any more. The log is written last.
    """
    current = materialise(_latest(_read(spark, f"{root}/log", LOG)).where(~F.col("deleted")), "current")
    chunks = _read(spark, f"{root}/chunks", INDEX)
    kept = chunks.join(current.select("url", "batch_id"), ["url", "batch_id"], "left_semi")
    kept.select(*INDEX.fieldNames(), "batch_id").write.partitionBy("batch_id").mode("overwrite").parquet(f"{target}/chunks")
    current.select(*LOG.fieldNames(), "batch_id").write.partitionBy("batch_id").mode("overwrite").parquet(f"{target}/log")
