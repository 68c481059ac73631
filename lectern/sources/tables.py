"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAGES, RAW_DOCUMENTS, conform
from ..session import materialise


def read_table(spark: SparkSession, name_or_path: str, schema: T.StructType) -> DataFrame:
    """A catalog table or a parquet path with the declared columns; a missing or mistyped one is an error."""
    found = spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)
    return conform(found, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over all cores, if the scan alone would leave cores idle.

    A few small files or one large row group give few tasks, too few for the
    text work that follows. A large table has more splits than cores and stays
    as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def page_source(df: DataFrame, status_col: str | None = None) -> DataFrame:
    """Fetched pages; with a status column only those answered with 200."""
    if status_col is not None:
        df = df.where(F.col(status_col) == 200)
    return conform(df, PAGES)


def page_status_counts(df: DataFrame, status_col: str) -> DataFrame:
    """How many pages were answered with what, including the dropped ones."""
    return df.groupBy(F.col(status_col).alias("status")).agg(F.count("*").alias("n_pages"))


def documents_from_table(df: DataFrame, url: Column | None = None, title: Column | None = None) -> DataFrame:
    """A raw text table as documents ``(url, page_title, content)``."""
    conform(df, RAW_DOCUMENTS)
    return df.select(
        (F.col("doc_id").cast("string") if url is None else url).alias("url"),
        (F.col("source") if title is None else title).alias("page_title"),
        F.col("text").alias("content"),
    )


def write_table(df: DataFrame, name_or_path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a parquet path or a catalog table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name_or_path:
        writer.parquet(name_or_path)
    else:
        writer.format("parquet").saveAsTable(name_or_path)


def create_table_as(name: str, df: DataFrame, location: str | None = None) -> DataFrame:
    """Create or replace a catalog table from a query; unlike a bare CTAS it can be rerun."""
    writer = df.write.format("parquet").mode("overwrite")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def delete_null_content(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Rewrite the table at ``path`` without the rows that have no content.

    The rows that stay are written elsewhere first, as a table can't be
    replaced while it is read.
    """
    write_table(materialise(drop_null_content(read_table(spark, path, schema)), "kept"), path)


def drop_null_content(df: DataFrame) -> DataFrame:
    return df.where(F.col("content").isNotNull())
