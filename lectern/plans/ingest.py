"""Pages to documents to an index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunks import chunk_documents
from ..operators.index import upsert_index
from ..operators.pages import CONTENT, TITLE, documents_from_pages
from ..operators.store import Sync, sync_store
from ..schemas import DOCUMENTS
from ..session import materialise
from ..sources.tables import drop_null_content, page_source, read_table, write_table


def load_pages(
    spark: SparkSession,
    pages: DataFrame,
    target: str,
    status_col: str | None = None,
    title: str = TITLE,
    content: str = CONTENT,
) -> DataFrame:
    """Write the document table of fetched pages, without empty pages, and read it back.

    The filter runs on a written table, where it reaches the scan; on the
    plan itself it would extract each page twice.
    """
    extracted = materialise(documents_from_pages(page_source(pages, status_col), title, content), "extracted")
    write_table(drop_null_content(extracted), target)
    return read_table(spark, target, DOCUMENTS)


def index_documents(spark: SparkSession, documents: DataFrame, root: str, **kw) -> DataFrame:
    """Create or sync the index of a document table.

    The chunk table is written first: a sync reads it twice, to find what
    changed and to embed that.
    """
    return upsert_index(spark, root, materialise(chunk_documents(documents), "chunks"), **kw)


def sync_documents(spark: SparkSession, documents: DataFrame, root: str, **kw) -> Sync:
    """Create or sync the partitioned index of a document table: only partitions that hold a change are written."""
    return sync_store(spark, root, materialise(chunk_documents(documents), "chunks"), **kw)
