"""Change feed between stored snapshots by digest trees.

A snapshot is stored in leaves, hash partitions of its key. A leaf's digest is
the sum of its rows' digests, and each node above sums ``FAN`` others, up to one
root. Two snapshots are compared from the root down: below equal digests
nothing is looked at. Only the rows of differing leaves are read, which are
partitions of the tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import snapshot_diff
from .store import bucket_of

#: Children of a node, and levels below the root: FAN ** DEPTH leaves. Take leaves of some 256 MB.
FAN, DEPTH = 16, 2
_TREE = "level int, node int, n long, high decimal(38,0), low decimal(38,0)"


def _row_digest(cols: list[str]) -> list[Column]:
    """Two halves of a row's digest, as numbers that can be summed."""
    digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)").alias(name) for at, name in ((1, "high"), (16, "low"))]


def write_snapshot(df: DataFrame, path: str, key: str, cols: list[str], depth: int = DEPTH) -> None:
    """Store ``key`` and ``cols`` of ``df`` in leaves, with the tree of their digests.

    Keys may repeat and may be NULL. The tree is written last; without it there
    is no snapshot.
    """
    leaves = FAN**depth
    leaf = bucket_of(F.coalesce(F.col(key).cast("string"), F.lit("")), leaves)
    rows = df.select(key, *[c for c in cols if c != key]).withColumn("_leaf", leaf)
    rows.repartition(leaves, "_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(f"{path}/rows")
    sums = [F.count("*").alias("n"), F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low")]
    lowest = rows.select("_leaf", *_row_digest([key, *cols])).groupBy("_leaf").agg(*sums)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = lowest.select(levels, "_leaf", "n", "high", "low").withColumn("node", F.expr(f"_leaf div cast(power({FAN}, {depth} - level) AS int)").cast("int"))
    tree = nodes.groupBy("level", "node").agg(
        F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")]
    )
    # twice as many rows as leaves at most
    tree.coalesce(1).sortWithinPartitions("level", "node").write.mode("overwrite").parquet(f"{path}/tree")
    about = df.sparkSession.createDataFrame([(depth, rows.schema.json())], "depth int, schema string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


@dataclass
class TreeDiff:
    """``changes``: key, change_type. ``leaves``: those that were read. ``compared``: nodes whose digests were compared."""

    changes: DataFrame
    leaves: list[int]
    compared: int
    n_leaves: int


def tree_diff(spark: SparkSession, old: str, new: str, key: str, cols: list[str]) -> TreeDiff:
    """What inserts, updates and deletes lead from one stored snapshot to another, as ``snapshot_diff`` finds them."""
    about = {p: spark.read.parquet(f"{p}/about").first() for p in (old, new)}
    depth = about[old].depth
    if about[new].depth != depth:
        raise ValueError(f"the trees differ in depth: {depth} and {about[new].depth}")

    def level(path: str, at: int, parents: list[int] | None) -> dict:
        nodes = spark.read.schema(_TREE).parquet(f"{path}/tree").where(F.col("level") == at)
        if parents is not None:
            nodes = nodes.where(F.expr(f"node div {FAN}").isin(parents))
        return {r.node: (r.n, r.high, r.low) for r in nodes.collect()}

    differing, compared = None, 0
    for at in range(depth + 1):
        if differing == []:
            break
        # of each level the children of differing nodes, at most as many as there are leaves
        a, b = level(old, at, differing), level(new, at, differing)
        compared += len(a.keys() | b.keys())
        differing = sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n))
    leaves = differing or []

    def rows(path: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(about[path].schema))
        return spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("_leaf").isin(leaves) if leaves else F.lit(False)).drop("_leaf")

    return TreeDiff(snapshot_diff(rows(old), rows(new), key, cols), leaves, compared, FAN**depth)
