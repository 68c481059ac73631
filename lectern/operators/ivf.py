"""Approximate search in an inverted file of product-quantised vectors.

Unit vectors are divided into cells around ``K`` directions. A vector is stored
once, in the cell of its nearest direction, as the codes of its residual: the
residual is cut into parts, and each part becomes the number of the nearest
codeword of that part. 64 floats become 8 bytes.

A question probes several cells instead of the items being stored in several.
Its inner product with an item is that with the cell's direction plus, for each
part, that with the item's codeword, which one small table per question holds
for all items. The best few by that sum are then scored exactly.

Directions and codewords are means, found by rounds of assignment in tasks and
sums by Spark; what is sent around is bounded by their number, not by the data.
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
from .search import PLACES, _keys, _matrix, _scored_schema, rank_hits

#: Cells, parts of a vector, codewords per part, rounds of each fit.
CELLS, PARTS, CODES, ROUNDS = 256, 8, 64, 6
#: Cells that a question probes, and candidates per question that are scored exactly.
PROBES, SHORTLIST = 8, 32
#: Rows of one side that a task gets of a cell.
QUESTION_BLOCK, ITEM_BLOCK = 4096, 65536
#: Scores that a task holds at once.
_TILE = 500_000


@dataclass
class Quantiser:
    """``centres``: cells x dimensions, of unit length. ``words``: parts x codewords x dimensions of a part."""

    centres: np.ndarray
    words: np.ndarray

    def cell(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest direction, the first of equal ones."""
        return np.argmax(np.round(unit @ self.centres.T, 9), axis=1)

    def parts(self, residual: np.ndarray) -> np.ndarray:
        """parts x vectors x dimensions of a part."""
        n, (m, _, size) = len(residual), self.words.shape
        return residual.reshape(n, m, size).transpose(1, 0, 2)

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """vectors x parts: the nearest codeword of each part of the residual, the first of equal ones."""
        found = []
        for part, words in zip(self.parts(unit - self.centres[cell]), self.words, strict=True):
            near = (words**2).sum(axis=1) - 2 * part @ words.T
            found.append(np.argmin(np.round(near, 9), axis=1))
        return np.stack(found, axis=1)


def _unit(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "embedding").where("embedding IS NOT NULL")


def _sums(df: DataFrame, groups: int, width: int, assign) -> np.ndarray:
    """groups x (1 + width): number and sum of the vectors that ``assign`` gives each group; a task sends one row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, width + 1))
        for batch in batches:
            if batch.num_rows:
                for group, vectors in assign(_matrix(batch.column("embedding"))):
                    np.add.at(total[:, 1:], group, vectors)
                    total[:, 0] += np.bincount(group, minlength=groups)
        held = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(list(total[held]), pa.list_(pa.float64()))], ["g", "total"])

    partial = df.select("embedding").mapInArrow(run, "g int, total array<double>")
    rows = partial.groupBy("g").agg(*[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width + 1)]).collect()
    out = np.zeros((groups, width + 1))
    for r in rows:
        out[r.g] = r[1:]
    return out


def _first(df: DataFrame, key: str, n: int) -> np.ndarray:
    """Up to ``n`` vectors as starts: those with the smallest hash of their key, repeated if there are fewer."""
    rows = df.orderBy(F.xxhash64(key), key).limit(n).select("embedding").toArrow()
    vectors = _matrix(rows.column("embedding"))
    if not len(vectors):
        raise ValueError("there are no vectors to learn from")
    return vectors[np.arange(n) % len(vectors)]


def fit(items: DataFrame, iid: str = "chunk_id", cells: int = CELLS, parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS) -> Quantiser:
    """Directions and codewords of ``items`` by rounds of k-means over all of them; the same in every run.

    Each round is one scan and sums of ``cells`` rows per task. Give a sample
    of a large table: a few hundred vectors per cell are enough. The length of
    the vectors must be a multiple of ``parts``.
    """
    df = materialise(_unit(items, iid), "learnt")
    centres = _first(df, iid, cells)
    dim = centres.shape[1]
    if dim % parts:
        raise ValueError(f"vectors of {dim} numbers have no {parts} equal parts")
    size = dim // parts
    for _ in range(rounds):
        made = Quantiser(centres, np.zeros((parts, 1, size)))
        found = _sums(df, cells, dim, lambda unit, made=made: [(made.cell(unit), unit)])
        length = np.linalg.norm(found[:, 1:], axis=1)
        centres = np.where((length > 0)[:, None], found[:, 1:] / np.where(length > 0, length, 1)[:, None], centres)
    starts = _first(df, iid, codes)
    made = Quantiser(centres, np.zeros((parts, codes, size)))
    words = made.parts(starts - centres[made.cell(starts)]).copy()
    words += 1e-9 * np.arange(codes)[None, :, None]  # equal starts part ways
    for _ in range(rounds):
        made = Quantiser(centres, words)

        def assign(unit: np.ndarray, made: Quantiser = made) -> list:
            cell = made.cell(unit)
            own, split = made.codes(unit, cell), made.parts(unit - made.centres[cell])
            return [(own[:, m] + m * codes, split[m]) for m in range(parts)]

        found = _sums(df, parts * codes, size, assign).reshape(parts, codes, size + 1)
        words = np.where(found[:, :, :1] > 0, found[:, :, 1:] / np.maximum(found[:, :, :1], 1), words)
    return Quantiser(centres, words)


def build(items: DataFrame, quantiser: Quantiser, iid: str = "chunk_id") -> DataFrame:
    """The inverted file, written: ``(iid, _cell, _codes)``, a row per vector, in the order of the cells."""
    sent = items.sparkSession.sparkContext.broadcast(quantiser)
    schema = T.StructType([items.schema[iid], T.StructField("_cell", T.IntegerType()), T.StructField("_codes", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    wide = "<u2" if quantiser.words.shape[1] > 256 else "u1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column("embedding"))
                cell = sent.value.cell(unit)
                codes = sent.value.codes(unit, cell).astype(wide)
                yield pa.RecordBatch.from_arrays([batch.column(iid), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], schema=arrow)

    return materialise(_unit(items, iid).mapInArrow(run, schema).sortWithinPartitions("_cell"), "inverted")


def probes(questions: DataFrame, quantiser: Quantiser, n: int = PROBES, qid: str = "query_id") -> DataFrame:
    """``(qid, embedding, _cell)``: the ``n`` cells nearest to each question; the vector comes as a unit."""
    sent = questions.sparkSession.sparkContext.broadcast(quantiser.centres)
    n = min(n, len(quantiser.centres))
    schema = T.StructType(
        [questions.schema[qid], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("_cells", T.ArrayType(T.IntegerType()))]
    )
    arrow = to_arrow_schema(schema)

    def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(list(rows), pa.list_(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column("embedding"))
                near = np.argsort(-np.round(unit @ sent.value.T, 9), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([batch.column(qid), listed(unit, pa.float64()), listed(near.astype(np.int32), pa.int32())], schema=arrow)

    return _unit(questions, qid).mapInArrow(run, schema).select(qid, "embedding", F.explode("_cells").alias("_cell"))


class _Shortlist:
    """Scores of one block of questions against items of one cell, from tables."""

    def __init__(self, unit: np.ndarray, quantiser: Quantiser, cell: int):
        self.start = unit @ quantiser.centres[cell]
        self.tables = np.einsum("mqd,mcd->mqc", quantiser.parts(unit), quantiser.words)

    def best(self, codes: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, item, units of the rounded score): the best ``k``, ties by key."""
        order = np.argsort(items, kind="stable")
        items, codes = items[order], codes[order]
        n, take = len(items), min(k, len(items))
        who, what, units = [], [], []
        step = max(1, _TILE // n)
        for at in range(0, len(self.start), step):
            score = np.repeat(self.start[at : at + step, None], n, axis=1)
            for table, code in zip(self.tables, codes.T, strict=True):
                score += table[at : at + step][:, code]
            rounded = np.nan_to_num(np.rint(score * 10**PLACES), nan=-(10.0**PLACES) * 4).astype(np.int64)
            rank = rounded * n + np.arange(n - 1, -1, -1)
            top = np.argpartition(rank, n - take, axis=1)[:, n - take :]
            who.append(np.repeat(np.arange(at, at + len(score)), take))
            what.append(items[top].ravel())
            units.append(np.take_along_axis(rounded, top, axis=1).ravel())
        return np.concatenate(who), np.concatenate(what), np.concatenate(units)


def shortlist(
    questions: DataFrame,
    inverted: DataFrame,
    quantiser: Quantiser,
    size: int = SHORTLIST,
    n_probes: int = PROBES,
    qid: str = "query_id",
    iid: str = "chunk_id",
) -> DataFrame:
    """``(qid, iid, score)``: the best ``size`` items of each question by their codes, among the cells it probes."""
    asked = materialise(probes(questions, quantiser, n_probes, qid), "probes")
    sent = questions.sparkSession.sparkContext.broadcast(quantiser)
    # a row per cell, of which there is a fixed number
    n_q = asked.groupBy("_cell").agg(F.ceil(F.count("*") / QUESTION_BLOCK).cast("int").alias("_nq"))
    n_i = inverted.groupBy("_cell").agg(F.ceil(F.count("*") / ITEM_BLOCK).cast("int").alias("_ni"))
    blocks = F.broadcast(materialise(n_q.join(n_i, "_cell"), "cells"))

    def own(key: str, n: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = asked.join(blocks, "_cell").select("_cell", qid, "embedding", own(qid, "_nq").alias("_qb"), every("_ni").alias("_ib"))
    right = inverted.join(blocks, "_cell").select("_cell", iid, "_codes", own(iid, "_ni").alias("_ib"), every("_nq").alias("_qb"))
    schema = _scored_schema(questions, inverted, qid, iid)
    arrow = to_arrow_schema(schema)
    wide = "<u2" if quantiser.words.shape[1] > 256 else "u1"

    def run(q: pa.Table, i: pa.Table) -> pa.Table:
        if not q.num_rows or not i.num_rows:
            return arrow.empty_table()
        codes = np.frombuffer(b"".join(i.column("_codes").to_pylist()), wide).reshape(i.num_rows, -1)
        flat = q.column("embedding").combine_chunks().flatten().to_numpy().reshape(q.num_rows, -1)
        who, what, units = _Shortlist(flat, sent.value, q.column("_cell")[0].as_py()).best(codes, _keys(i.column(iid)), size)
        names = _keys(q.column(qid))[who]
        return pa.Table.from_arrays([pa.array(names, arrow.field(0).type), pa.array(what, arrow.field(1).type), pa.array(units / 10**PLACES)], schema=arrow)

    by = ["_cell", "_qb", "_ib"]
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
    return rank_hits(scored, size, qid, iid).drop("rk")


def _exact(pairs: DataFrame, qid: str, iid: str, schema: T.StructType) -> DataFrame:
    """Cosines of rows (qid, iid, q, v), batch by batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _matrix(batch.column("q")), _matrix(batch.column("v")))
                score = np.rint(cosine * 10**PLACES) / 10**PLACES
                yield pa.RecordBatch.from_arrays([batch.column(qid), batch.column(iid), pa.array(score, from_pandas=True)], schema=arrow)

    return pairs.select(qid, iid, "q", "v").mapInArrow(run, schema).where("score IS NOT NULL")


def topk_ivf(
    questions: DataFrame,
    items: DataFrame,
    inverted: DataFrame,
    quantiser: Quantiser,
    k: int,
    n_probes: int = PROBES,
    size: int = SHORTLIST,
    qid: str = "query_id",
    iid: str = "chunk_id",
) -> DataFrame:
    """Approximate ``k`` nearest items: ``(qid, iid, score, rk)`` with exact scores.

    ``inverted`` is ``build(items, quantiser)`` and moves a few bytes per item;
    of the vectors only those on a shortlist are read from ``items``.
    """
    found = materialise(shortlist(questions, inverted, quantiser, size, n_probes, qid, iid).select(qid, iid), "shortlist")
    wanted = found.select(iid).distinct()
    vectors = _unit(items, iid).join(wanted, iid, "left_semi").select(iid, F.col("embedding").alias("v"))
    asked = _unit(questions, qid).select(qid, F.col("embedding").alias("q"))
    pairs = found.join(vectors, iid).join(asked, qid)
    return rank_hits(_exact(pairs, qid, iid, _scored_schema(questions, items, qid, iid)), k, qid, iid)


def ivf_cost(
    questions: DataFrame, inverted: DataFrame, quantiser: Quantiser, n_probes: int = PROBES, size: int = SHORTLIST, qid: str = "query_id"
) -> DataFrame:
    """``(n_questions, n_items, n_scored, n_exact)``: pairs that are scored by codes, and exactly at most."""
    asked = probes(questions, quantiser, n_probes, qid)
    held = inverted.groupBy("_cell").agg(F.count("*").alias("n"))
    each = asked.join(F.broadcast(held), "_cell", "left").groupBy(qid).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = inverted.agg(F.count("*").alias("n_items"))
    return each.agg(
        F.count("*").alias("n_questions"), F.sum("n").alias("n_scored"), F.sum(F.least("n", F.lit(size))).alias("n_exact")
    ).join(total).select("n_questions", "n_items", "n_scored", "n_exact")
