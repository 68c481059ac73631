"""The URLs that earlier crawls have seen, in a stored Bloom filter and a table.

The filter answers for most new URLs that they were never seen, without a join
and without reading the table: bits are built by an aggregate over words of 32
bits, and are looked up in tasks. Only URLs that the filter takes for seen are
joined with the table, so a false alarm costs a little time and loses nothing.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Bits of the filter, and bits per URL: 2^24 bits hold 1.7 million URLs at a false alarm in a hundred. The filter, an
#: eighth of its bits in bytes, travels with the tasks, so its size is given and does not grow with the crawl.
BITS, PROBES = 1 << 24, 7
_WORD = 32


def _places(url: Column, bits: int) -> Column:
    """The bits of a URL, from two hashes; the step is odd, so it does not come back soon."""
    first, second = F.pmod(F.xxhash64(url), F.lit(bits)), F.pmod(F.xxhash64(url, F.lit(1)), F.lit(bits)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(first + i * second, F.lit(bits)))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def filter_words(urls: DataFrame, bits: int = BITS) -> DataFrame:
    """``(word, value)``: the words of the filter that are not zero."""
    place = urls.select(F.explode(_places(F.col("url"), bits)).alias("place"))
    bit = F.expr(f"shiftleft(1L, CAST(place % {_WORD} AS INT))")
    return place.groupBy(F.expr(f"place div {_WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("value"))


def probably_seen(frontier: DataFrame, words: DataFrame, bits: int = BITS) -> DataFrame:
    """``frontier`` with ``maybe``: whether the filter holds the row's ``url``; a NULL URL is never held."""
    held = words.toArrow()  # bits / 32 rows at most
    table = np.zeros(-(-bits // _WORD), dtype=np.uint32)
    table[held.column("word").to_numpy()] = held.column("value").to_numpy().astype(np.uint32)
    sent = frontier.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def holds(places: pa.Array) -> pa.Array:
        at = places.flatten().to_numpy(zero_copy_only=False).reshape(len(places), PROBES)
        return pa.array(((sent.value[at // _WORD] >> (at % _WORD).astype(np.uint32)) & 1).all(axis=1))

    return frontier.withColumn("maybe", F.col("url").isNotNull() & holds(_places(F.coalesce("url", F.lit("")), bits)))


def unseen(spark: SparkSession, root: str, frontier: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``frontier`` whose ``url`` no crawl that was noted below ``root`` has seen; rows without a URL are left out."""
    rows = frontier.where("url IS NOT NULL")
    words = _table(spark, f"{root}/filter", "word int, value long")
    if words is None:
        return rows
    marked = probably_seen(rows, words.groupBy("word").agg(F.bit_or("value").alias("value")), bits)
    marked = materialise(marked, "marked")
    known = spark.read.schema("url string").parquet(f"{root}/urls")
    again = marked.where("maybe").join(known, "url", "left_anti")
    return marked.where("NOT maybe").unionByName(again.select(marked.columns)).select(*frontier.columns)


def note_seen(spark: SparkSession, root: str, urls: DataFrame, crawl: int, bits: int = BITS) -> None:
    """Note the URLs of a crawl; noting a crawl again replaces what was noted.

    The table is written before the filter: URLs are only taken for unseen by a
    filter that lacks them.
    """
    new = materialise(urls.select("url").where("url IS NOT NULL").distinct(), "new")
    new.write.mode("overwrite").parquet(f"{root}/urls/crawl={crawl}")
    filter_words(new, bits).coalesce(1).write.mode("overwrite").parquet(f"{root}/filter/crawl={crawl}")


def alarms(frontier: DataFrame, seen: DataFrame, bits: int = BITS) -> DataFrame:
    """``(n_urls, n_maybe, n_seen)``: distinct URLs, those that a filter of ``seen`` takes for seen, and those that were."""
    urls = frontier.select("url").where("url IS NOT NULL").distinct()
    marked = probably_seen(urls, filter_words(seen.where("url IS NOT NULL"), bits), bits)
    truth = seen.select("url").distinct().withColumn("was", F.lit(True))
    return marked.join(truth, "url", "left").agg(F.count("*").alias("n_urls"), F.count_if("maybe").alias("n_maybe"), F.count("was").alias("n_seen"))
