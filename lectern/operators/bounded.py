"""Exact nearest neighbours that leave out blocks by the angle inequality.

Items are cut into blocks: those nearest to one of some pivots and at about
the same angle from it. A question at angle ``a`` from the pivot is at least
``lo - a`` and ``a - hi`` away from a block whose items are ``lo`` to ``hi`` from
it. The blocks that may be nearest are scored first and give each question a
score that its ``k``-th neighbour has at least; of the others only those are
scored whose bound reaches it. Any pivots give the exact result; good ones
leave out more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise
from .search import PLACES, _grid, _matrix, _scored_schema, rank_hits

#: Rings around a pivot, by angle.
RINGS = 32
#: Above what rounding takes from an angle or a score.
_SLACK = 1e-6
#: Questions times blocks whose bounds a task holds at once.
_CELLS = 1 << 17


@dataclass
class Blocks:
    """``items``: key, embedding, _cell, _ring, written. ``sizes``: a row (_cell, _ring, n, lo, hi) per block, pivots x rings at most."""

    items: DataFrame
    sizes: DataFrame
    pivots: np.ndarray


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def block(items: DataFrame, pivots: np.ndarray, iid: str = "chunk_id", rings: int = RINGS) -> Blocks:
    """Deal ``items`` into blocks around unit vectors, such as the directions of ``ivf.fit``. Zero vectors have no angle and are left out."""
    sent = items.sparkSession.sparkContext.broadcast(pivots)
    extra = [T.StructField("_cell", T.IntegerType()), T.StructField("_ring", T.IntegerType()), T.StructField("_angle", T.DoubleType())]
    schema = T.StructType([items.schema[iid], items.schema["embedding"], *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column("embedding"))
                held = ~np.isnan(unit).any(axis=1)
                angle = _angles(np.nan_to_num(unit), sent.value)
                cell = angle.argmin(axis=1)
                near = angle[np.arange(len(cell)), cell]
                ring = np.minimum(rings - 1, near * rings / np.pi).astype(np.int32)
                made = pa.RecordBatch.from_arrays(
                    [batch.column(iid), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(ring), pa.array(near)], schema=arrow
                )
                yield made.filter(pa.array(held))

    dealt = materialise(items.select(iid, "embedding").where("embedding IS NOT NULL").mapInArrow(run, schema), "blocks")
    sizes = dealt.groupBy("_cell", "_ring").agg(F.count("*").alias("n"), F.min("_angle").alias("lo"), F.max("_angle").alias("hi"))
    return Blocks(dealt.drop("_angle"), materialise(sizes, "sizes"), pivots)


def _bounds(questions: DataFrame, blocks: Blocks, k: int, qid: str) -> DataFrame:
    """(qid, _cell, _ring, n, bound, first) of every question and block; ``first`` marks the likeliest blocks that hold ``k`` items."""
    sizes = blocks.sizes.toPandas()
    cell, ring, n, lo, hi = (sizes[c].to_numpy() for c in ("_cell", "_ring", "n", "lo", "hi"))
    sent = questions.sparkSession.sparkContext.broadcast((blocks.pivots, cell, ring, n, lo, hi))
    entry = "struct<_cell:int,_ring:int,n:long,bound:double,first:boolean>"
    kind = questions.schema[qid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cell, ring, n, lo, hi = sent.value
        step = max(1, _CELLS // max(1, len(cell)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            unit = _matrix(batch.column("embedding"))
            angle = _angles(np.nan_to_num(unit), pivots)[:, cell]
            bound = np.cos(np.maximum(0, np.maximum(angle - hi, lo - angle))) + _SLACK
            by = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[by], axis=1) - n[by]
            first = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(first, by, before < k, axis=1)
            rows, at = len(bound), np.tile(np.arange(len(cell)), len(bound))
            entries = pa.StructArray.from_arrays(
                [pa.array(cell[at], pa.int32()), pa.array(ring[at], pa.int32()), pa.array(n[at], pa.int64()), pa.array(bound.ravel()), pa.array(first.ravel())],
                ["_cell", "_ring", "n", "bound", "first"],
            )
            offsets = pa.array(np.arange(rows + 1) * len(cell), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(qid), pa.ListArray.from_arrays(offsets, entries)], [qid, "blocks"])

    asked = questions.select(qid, "embedding").where("embedding IS NOT NULL")
    return asked.mapInArrow(run, f"`{qid}` {kind}, blocks array<{entry}>").select(qid, F.explode("blocks").alias("b")).select(qid, "b.*")


def _searched(questions: DataFrame, blocks: Blocks, k: int, qid: str, iid: str) -> tuple[DataFrame, DataFrame]:
    """The hits of the first blocks, and the (qid, _cell, _ring, n) that must be scored besides."""
    schema = _scored_schema(questions, blocks.items, qid, iid)
    cells = ["_cell", "_ring"]
    asked = questions.select(qid, "embedding").where("embedding IS NOT NULL")
    bounds = _bounds(questions, blocks, k, qid)
    likely = asked.join(bounds.where("first").select(qid, *cells), qid)
    first = materialise(rank_hits(_grid(likely, blocks.items, k, qid, iid, schema, cells), k, qid, iid), "first")
    least = first.where(F.col("rk") == k).select(qid, F.col("score").alias("least"))
    # the bounds are computed once more rather than kept: they are questions times blocks
    rest = bounds.where("NOT first").join(least, qid, "left").where(f"least IS NULL OR bound >= least - {10.0**-PLACES}")
    return first, rest.select(qid, *cells, "n")


def topk_bounded(questions: DataFrame, blocks: Blocks, k: int, qid: str = "query_id", iid: str = "chunk_id") -> DataFrame:
    """Exact ``k`` nearest items of every question, as ``topk_vector`` finds them: ``(qid, iid, score, rk)``."""
    schema = _scored_schema(questions, blocks.items, qid, iid)
    first, rest = _searched(questions, blocks, k, qid, iid)
    asked = questions.select(qid, "embedding").where("embedding IS NOT NULL").join(rest.drop("n"), qid)
    more = _grid(asked, blocks.items, k, qid, iid, schema, ["_cell", "_ring"])
    return rank_hits(first.drop("rk").unionByName(more), k, qid, iid)


def bounded_cost(questions: DataFrame, blocks: Blocks, k: int, qid: str = "query_id", iid: str = "chunk_id") -> DataFrame:
    """``(n_pairs, n_scored)``: all pairs of question and item, and those that are scored."""
    _, rest = _searched(questions, blocks, k, qid, iid)
    first = _bounds(questions, blocks, k, qid)
    pairs = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("likely"))
    return pairs.join(rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("more"))).select("n_pairs", (F.col("likely") + F.col("more")).alias("n_scored"))
