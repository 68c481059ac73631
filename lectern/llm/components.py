"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reached.

    Each round points every neighbour of a node to the smallest of them, in
    turn among larger and among smaller neighbours, so stars grow and merge
    until each component is one. The table never gets more rows than edges,
    and a round is written, so no lineage grows.
    """
    ordered = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(edges.where("a <> b").select(ordered.alias("e")).select("e.*").distinct(), "edges")
    mark = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "edges")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            floor.select("a", F.col("m").alias("b"))
        )
        now = materialise(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
