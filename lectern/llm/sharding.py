"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows with equal text stay together. Groups sorted by size go one after another
to the least loaded shard, which a heap gives. Only groups of at least
1/``FINENESS`` of a shard are scheduled one by one; smaller ones are first
bundled by hash, so the driver sees at most ``2 * shards * FINENESS`` sizes
whatever the data, and a shard is off by about one bundle at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise
from .common import narrow

FINENESS = 1024
#: A shard's rows are numbered in this many parts.
PARTS = 256
#: Bytes a row costs besides its text.
OVERHEAD = 8


def schedule(items: Iterable[tuple], shards: int) -> dict:
    """shard of each key of (key, size) items: largest first, to the least loaded, ties to the smaller key and shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _group(text: Column) -> Column:
    """Key of a text. Should two texts ever share a key, they only stay together."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


@dataclass
class Plan:
    """Where groups go: a row per large group and per bundle, both bounded by ``shards * FINENESS``."""

    shards: int
    large: DataFrame
    bundles: DataFrame


def _bundle(group: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(group, F.lit(1)), F.lit(shards * FINENESS))


def fit(measured: DataFrame, shards: int) -> Plan:
    """The plan for rows (group, size); an empty table gives an empty plan."""
    spark = measured.sparkSession
    total = measured.agg(F.sum("size").alias("n")).first().n or 0
    groups = measured.groupBy("group").agg(F.sum("size").alias("size"))
    large = F.col("size") * (shards * FINENESS) >= F.lit(total)  # of these there are shards * FINENESS at most
    items = (
        groups.select(large.alias("large"), F.when(large, F.col("group")).otherwise(_bundle(F.col("group"), shards)).alias("key"), "size")
        .groupBy("large", "key")
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    placed = schedule((((r.large, r.key), r.size) for r in items), shards)
    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("shard", T.IntegerType())])

    def part(wanted: bool) -> DataFrame:
        return spark.createDataFrame([(k, s) for (is_large, k), s in placed.items() if is_large is wanted], kind)

    return Plan(shards, part(True), part(False))


def place(df: DataFrame, plan: Plan, group: Column) -> DataFrame:
    """``df`` with its shard as column ``shard``; nothing is shuffled, the plan's size is bounded."""
    large = plan.large.select(F.col("key").alias("__large"), F.col("shard").alias("__by_group"))
    small = plan.bundles.select(F.col("key").alias("__bundle"), F.col("shard").alias("__by_bundle"))
    keyed = df.withColumns({"__group": group}).drop("shard").withColumn("__part", _bundle(F.col("__group"), plan.shards))
    return (
        keyed.join(F.broadcast(large), F.col("__group") == F.col("__large"), "left")
        .join(F.broadcast(small), F.col("__part") == F.col("__bundle"), "left")
        .withColumn("shard", F.coalesce("__by_group", "__by_bundle"))
        .drop("__group", "__part", "__large", "__by_group", "__bundle", "__by_bundle")
    )


def assign(df: DataFrame, shards: int, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``shard`` (one of that name is replaced), equal texts together.

    A null text counts as the empty text. Repeated rows are rows like others.
    """
    text = F.col(f"`{text_col}`")
    measured = materialise(df.select(_group(text).alias("group"), _size(text).alias("size")), "sizes")
    kept = F.struct([F.col(f"`{c}`") for c in df.columns if c != "shard"]).alias("row")
    rows = df.select(kept, _group(text).alias("group"))
    return place(rows, fit(measured, shards), F.col("group")).select("row.*", "shard")


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot of every row.

    ``slot`` counts a shard's rows from 0 without a gap. Rows are numbered in
    parts by a hash of the id, so a shard that holds most rows is not sorted
    by one task; null ids come first and equal rows are interchangeable.
    """
    text = F.col("text")
    rows = materialise(
        narrow(df, id=id_col, text=text_col).select(
            "id",
            _size(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            _group(text).alias("group"),
        ),
        "sizes",
    )
    placed = place(rows, fit(rows, shards), F.col("group")).withColumn(
        "part", F.pmod(F.xxhash64("id", "group"), F.lit(PARTS))
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("id", "group", "size")
    return (
        placed.join(F.broadcast(offsets), ["shard", "part"])  # shards * PARTS rows
        .withColumn("slot", F.col("offset") + F.row_number().over(within) - 1)
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, shards: int, text_col: str = "text", files: int = 8) -> None:
    """``df`` as Parquet in one folder per shard, each in up to ``files`` files, so a large shard is no single task."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    placed = assign(df, shards, text_col)
    placed.repartition(shards * files, "shard", deal).write.mode("overwrite").partitionBy("shard").parquet(path)
