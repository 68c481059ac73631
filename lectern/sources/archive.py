"""Pages in web archive files: records of headers and an HTTP response, one after the other.

Spark's text source cuts the files at the beginning of a record, so a large
file is read in splits, by whatever store Spark reads, and compressed files by
their extension. Each record says how many bytes its response has; a record of
another length, or without the headers that a page needs, is reported as a
problem and is never taken for a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAGES, conform

# Fixed values of the format.
VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"


def _header(block: Column, name: str) -> Column:
    """A header's value, NULL if it is not there."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, status, html, problem)``, a row per record of a response.

    ``problem`` is NULL for a sound record. A page that quotes the beginning of
    a record is cut there; as the lengths tell, both parts are reported. Other
    kinds of records are left out.
    """
    lines = spark.read.text(path, lineSep=END + VERSION).where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "")
    whole = lines.select(F.regexp_replace("value", f"^{VERSION}", "").alias("record"))
    at = F.instr("record", END)
    split = whole.select(
        F.when(at > 0, F.substr("record", F.lit(1), at - 1)).otherwise(F.col("record")).alias("head"),
        F.when(at > 0, F.substr("record", at + len(END))).alias("response"),
    )
    named = split.select(
        "response",
        _header(F.col("head"), "WARC-Type").alias("kind"),
        _header(F.col("head"), "WARC-Record-ID").try_cast("bigint").alias("page_id"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"),
        _header(F.col("head"), "Content-Length").try_cast("bigint").alias("length"),
    ).where("kind IS NULL OR kind = 'response'")
    # the last record of a file has its end mark still
    ended = F.col("response").endswith(END) & (F.octet_length("response") == F.col("length") + len(END))
    named = named.withColumn("response", F.when(ended, F.substr("response", F.lit(1), F.char_length("response") - len(END))).otherwise(F.col("response")))
    body_at = F.instr("response", END)
    status = F.regexp_extract("response", r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int")
    problem = (
        F.when(F.col("kind").isNull() | F.col("url").isNull(), "headers are missing")
        .when(F.col("length").isNull(), "no length")
        .when(F.coalesce(F.octet_length("response"), F.lit(-1)) != F.col("length"), "other length")
        .when(F.coalesce(body_at, F.lit(0)) == 0, "no response")
    )
    return named.select("page_id", "url", status.alias("status"), F.substr("response", body_at + len(END)).alias("html"), problem.alias("problem")).withColumn(
        "html", F.when(F.col("problem").isNull(), F.col("html"))
    )


def archived_pages(records: DataFrame, status: int = 200) -> DataFrame:
    """The sound records answered with ``status`` as pages; the filter is applied before any markup is touched."""
    return conform(records.where(F.col("problem").isNull() & (F.col("status") == status)), PAGES)


def archive_problems(records: DataFrame) -> DataFrame:
    """``(problem, n_records)``: what is wrong with how many records."""
    return records.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n_records"))


def write_archive(pages: DataFrame, path: str, status: Column | None = None) -> None:
    """Pages ``(page_id, url, html)`` as archive files; NULL markup is written as empty."""
    code = F.lit(200) if status is None else status
    response = F.concat(F.lit("HTTP/1.1 "), code.cast("string"), F.lit(f" -\r\nContent-Type: text/html; charset=utf-8{END}"), F.coalesce("html", F.lit("")))
    sized = pages.select("page_id", "url", response.alias("response"))
    record = F.concat(
        F.lit(f"{VERSION}WARC-Type: response\r\nWARC-Record-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length("response").cast("string"), F.lit(END), F.col("response"),
    )
    sized.select(record.alias("value")).write.mode("overwrite").text(path, lineSep=END)
