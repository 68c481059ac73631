"""Nearest neighbours for whole tables of questions.

Scores are cosines rounded to six places; equal scores are ordered by item key.
No pair of question and item is ever a row: pairs are scored inside a task as
one matrix product per Arrow batch, and only each task's best ``k`` leave it.

* Few questions (checked by reading at most the bound): they are sent to every
  task and the index is scanned once, without a shuffle.
* More questions: both sides are cut into blocks of bounded size by a hash of
  their keys, large enough that vectors move rarely, and each pair of blocks is one group. No group grows with the
  data, however the keys or buckets are distributed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import materialise
from .embedding import DIM, embed

# Fixed values.
RETRIEVED = 4
SEARCHED = 2

PLACES = 6
SENT_QUESTIONS = 4096
QUESTION_BLOCK = 32768
ITEM_BLOCK = 65536
#: Smaller blocks of items are made while there are fewer pairs of blocks than cores ask for, down to this many.
LEAST_BLOCK, GROUPS_PER_CORE = 4096, 4
#: Hits that are sent to all tasks: a key, a question key, a score and a rank each, some 100 bytes.
SENT_HITS = 4 * SENT_QUESTIONS
SALTS = 16
HOT_ROWS = 100_000
LSH_BITS, LSH_TABLES = 8, 16
_TILE_CELLS = 500_000
#: Items that are scored first, whose best give a score that others must reach.
_PROBED = 2048


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length lists as rows of a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    if len(pc.unique(pc.list_value_length(column))) != 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The same as unit rows."""
    m = _numbers(column)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Best:
    """The best ``k`` items of each question over the batches seen so far."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.k = questions, k
        self.score: np.ndarray | None = None
        self.item: np.ndarray | None = None

    def add(self, items: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(items, kind="stable")
        items, vectors = items[order], vectors[order]
        n, take = len(items), min(self.k, len(items))
        if take == 0 or len(self.questions) == 0:
            return
        probed = vectors[:: max(1, n // _PROBED)] if n > 4 * _PROBED and take * 8 < _PROBED else None
        singles = None if probed is None else vectors.astype(np.float32)
        scores, found = [], []
        tile = max(1, _TILE_CELLS // (n if probed is None else len(probed)))
        for at in range(0, len(self.questions), tile):
            asked = self.questions[at : at + tile]
            hits = None if probed is None else self._reaching(asked, vectors, singles, probed, take)
            if hits is None:
                few = max(1, _TILE_CELLS // n)
                parts = [self._all(asked[i : i + few], vectors, take) for i in range(0, len(asked), few)]
                hits = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            scores.append(hits[0])
            found.append(items[hits[1]])
        score, item = np.concatenate(scores), np.concatenate(found)
        if self.score is not None:
            score = np.concatenate([self.score, score], axis=1)
            item = np.concatenate([self.item, item], axis=1)
        if score.shape[1] > self.k:
            place = np.unique(item, return_inverse=True)[1].reshape(item.shape)
            best = np.lexsort((place, -score), axis=1)[:, : self.k]
            score, item = np.take_along_axis(score, best, 1), np.take_along_axis(item, best, 1)
        self.score, self.item = score, item

    @staticmethod
    def _all(asked: np.ndarray, vectors: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        """(rounded scores, places) of the best items of each question, from the scores of all."""
        n = len(vectors)
        # rounded score and place in key order as one integer, so ties need no second pass
        units = np.rint(asked @ vectors.T * 10**PLACES)
        rank = np.nan_to_num(units, nan=-(10.0**PLACES) * 2).astype(np.int64) * n
        rank += np.arange(n - 1, -1, -1)
        top = np.argpartition(rank, n - take, axis=1)[:, n - take :]
        return np.take_along_axis(units, top, axis=1), top

    @staticmethod
    def _reaching(asked: np.ndarray, vectors: np.ndarray, singles: np.ndarray, probed: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The same from those items alone that reach the best of ``probed``; None if these are few or very many reach them.

        All scores are looked at in single precision, whose error is far below
        the slack; what passes is scored like everything else.
        """
        first = asked @ probed.T
        least = np.partition(np.nan_to_num(first, nan=-2.0), len(probed) - take, axis=1)[:, len(probed) - take]
        known = ~np.isnan(asked).any(axis=1)
        if (least[known] < -1.5).any():
            return None
        slack = 2.0 * 10**-PLACES + asked.shape[1] * 4e-7
        bar = np.where(known, least - slack, np.nan).astype(np.float32)
        single, size = asked.astype(np.float32), max(1, _TILE_CELLS // len(asked))
        parts, room = [], 256 * len(asked)
        for at in range(0, len(vectors), size):
            near = single @ singles[at : at + size].T
            one, other = np.divmod(np.flatnonzero(near >= bar[:, None]), near.shape[1])
            room -= len(one)
            if room < 0:
                return None
            exact = [np.einsum("ij,ij->i", asked[one[i : i + 4096]], vectors[at + other[i : i + 4096]]) for i in range(0, len(one), 4096)]
            parts.append(np.stack([one, at + other, np.rint(np.concatenate([np.zeros(0), *exact]) * 10**PLACES)]))
        who, what, units = np.concatenate(parts, axis=1)
        by = np.lexsort((what, -units, who))
        who, what, units = who[by].astype(np.int64), what[by].astype(np.int64), units[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = place < take
        score, top = np.full((len(asked), take), np.nan), np.zeros((len(asked), take), dtype=np.int64)
        score[who[best], place[best]], top[who[best], place[best]] = units[best], what[best]
        return score, top

    def rows(self, names: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        if self.score is None:
            return pa.RecordBatch.from_pylist([], schema=schema)
        valid = ~np.isnan(self.score)
        who = np.broadcast_to(names[:, None], self.score.shape)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(who[valid], type=schema.field(0).type),
                pa.array(self.item[valid], type=schema.field(1).type),
                pa.array(self.score[valid] / 10**PLACES, type=pa.float64()),
            ],
            schema=schema,
        )


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _scored_schema(questions: DataFrame, items: DataFrame, qid: str, iid: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(qid, questions.schema[qid].dataType),
            T.StructField(iid, items.schema[iid].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan(questions: pa.Table, items: DataFrame, k: int, qid: str, iid: str, schema: T.StructType) -> DataFrame:
    """One pass over the items with all questions at hand."""
    names = _keys(questions.column(qid))
    vectors = _matrix(questions.column("embedding"))
    sent = items.sparkSession.sparkContext.broadcast((names, vectors))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        best = _Best(vectors, k)
        for batch in batches:
            if batch.num_rows:
                best.add(_keys(batch.column(iid)), _matrix(batch.column("embedding")))
        yield best.rows(names, arrow)

    return items.select(iid, "embedding").mapInArrow(run, schema)


def _grid(
    questions: DataFrame, items: DataFrame, k: int, qid: str, iid: str, schema: T.StructType, cells: list[str]
) -> DataFrame:
    """Pairs of bounded blocks, within equal ``cells`` columns if there are any."""
    # fresh column identities, as both sides may come from one table
    questions = questions.select(*[F.col(c).alias(c) for c in questions.columns])
    n_q = questions.groupBy(*cells).agg(F.ceil(F.count("*") / QUESTION_BLOCK).cast("int").alias("_nq"))
    n_i = items.groupBy(*cells).agg(F.ceil(F.count("*") / ITEM_BLOCK).cast("int").alias("_ni"))
    if cells:
        # one row per cell that has both sides; a hot cell must not meet it in a single task
        sizes = n_q.join(n_i, cells)
        questions, items = lookup(questions, sizes, cells, qid), lookup(items, sizes, cells, iid)
    else:
        wanted = F.lit(GROUPS_PER_CORE * questions.sparkSession.sparkContext.defaultParallelism)
        size = F.greatest(F.lit(min(LEAST_BLOCK, ITEM_BLOCK)), F.least(F.lit(ITEM_BLOCK), F.ceil(F.col("_n") * F.col("_nq") / wanted)))
        counts = n_q.crossJoin(items.agg(F.count("*").alias("_n"))).select("_nq", F.ceil(F.col("_n") / size).cast("int").alias("_ni")).first()
        both = {"_nq": F.lit(counts._nq), "_ni": F.lit(counts._ni)}
        questions, items = questions.withColumns(both), items.withColumns(both)

    def own(key: str, n: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    usable = (F.col("_nq") > 0) & (F.col("_ni") > 0)
    left = questions.where(usable).select(
        *cells, qid, "embedding", own(qid, "_nq").alias("_qb"), every("_ni").alias("_ib")
    )
    right = items.where(usable).select(
        *cells, iid, "embedding", own(iid, "_ni").alias("_ib"), every("_nq").alias("_qb")
    )
    by = [*cells, "_qb", "_ib"]
    arrow = to_arrow_schema(schema)

    def run(q: pa.Table, i: pa.Table) -> pa.Table:
        best = _Best(_matrix(q.column("embedding")), k)
        if q.num_rows and i.num_rows:
            best.add(_keys(i.column(iid)), _matrix(i.column("embedding")))
        return pa.Table.from_batches([best.rows(_keys(q.column(qid)), arrow)])

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def lookup(rows: DataFrame, unique: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join rows to a narrow table with one row per key, spreading each key over several tasks.

    The narrow side is repeated once per salt, so a key that holds a large part
    of ``rows`` is shared by ``SALTS`` tasks. The result is that of a plain join.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def rank_hits(scored: DataFrame, k: int, qid: str, iid: str) -> DataFrame:
    """``rk`` 1..k per question; the filter form lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(iid))
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def topk_vector(
    questions: DataFrame,
    items: DataFrame,
    k: int,
    qid: str = "query_id",
    iid: str = "chunk_id",
    sent_questions: int = SENT_QUESTIONS,
) -> DataFrame:
    """Exact ``k`` nearest items of every question: ``(qid, iid, score, rk)``."""
    questions = questions.select(qid, "embedding").where(F.col("embedding").isNotNull())
    items = items.select(iid, "embedding").where(F.col("embedding").isNotNull())
    schema = _scored_schema(questions, items, qid, iid)
    head = questions.limit(sent_questions + 1).toArrow()
    if head.num_rows <= sent_questions:
        scored = _scan(head, items, k, qid, iid, schema)
    else:
        scored = _grid(questions, items, k, qid, iid, schema, [])
    return rank_hits(scored, k, qid, iid)


def directions(dim: int, bits: int, tables: int) -> np.ndarray:
    """``dim`` x (tables * bits) signs, each from one digit of md5 of ``table:bit:dimension``: the same everywhere."""
    sign = [
        [1.0 if hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0] < "8" else -1.0 for t in range(tables) for b in range(bits)]
        for d in range(dim)
    ]
    return np.array(sign).reshape(dim, tables * bits)


def codes(df: DataFrame, key: str, bits: int = LSH_BITS, tables: int = LSH_TABLES) -> DataFrame:
    """``(key, embedding, _table, _code)``: per table the sides of ``bits`` directions that a vector lies on."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), df.schema["embedding"], T.StructField("_codes", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, weight = None, 1 << np.arange(bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _numbers(batch.column("embedding"))
            if signs is None:
                signs = directions(vectors.shape[1], bits, tables)
            side = (vectors @ signs > 0).reshape(len(vectors), tables, bits)
            flat = pa.array((side @ weight).astype(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables), flat)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("embedding"), listed], schema=arrow)

    rows = df.select(key, "embedding").where(F.col("embedding").isNotNull()).mapInArrow(run, schema)
    return rows.select(key, "embedding", F.posexplode("_codes").alias("_table", "_code"))


def topk_lsh(
    questions: DataFrame,
    items: DataFrame,
    k: int,
    qid: str = "query_id",
    iid: str = "chunk_id",
    bits: int = LSH_BITS,
    tables: int = LSH_TABLES,
) -> DataFrame:
    """Approximate ``k`` nearest items: only items that share a code of one of the tables are scored.

    A table splits the vectors into up to ``2^bits`` cells, so it scores about
    ``2^-bits`` of all pairs; take ``bits`` as the binary logarithm of the items
    over those wanted per cell. ``tables`` buys recall: neighbours at cosine 0.9
    share one of 16 codes of 8 bits with probability 0.99, those at 0.4 with
    0.33. A cell is cut into bounded blocks, all of which are scored.
    """
    schema = _scored_schema(questions, items, qid, iid)
    scored = _grid(
        codes(questions, qid, bits, tables), codes(items, iid, bits, tables), k, qid, iid, schema, ["_table", "_code"]
    )
    return rank_hits(scored.groupBy(qid, iid).agg(F.max("score").alias("score")), k, qid, iid)


def lsh_cost(
    questions: DataFrame, items: DataFrame, qid: str = "query_id", iid: str = "chunk_id", bits: int = LSH_BITS, tables: int = LSH_TABLES
) -> DataFrame:
    """``(n_questions, n_items, n_scored)``: how many pairs ``topk_lsh`` scores, over all tables."""
    cells = ["_table", "_code"]
    asked = codes(questions, qid, bits, tables).groupBy(*cells).agg(F.count("*").alias("_nq"))
    held = codes(items, iid, bits, tables).groupBy(*cells).agg(F.count("*").alias("_ni"))
    scored = asked.join(held, cells).agg(F.coalesce(F.sum(F.col("_nq") * F.col("_ni")), F.lit(0)).alias("n_scored"))
    counts = [df.where("embedding IS NOT NULL").agg(F.count("*").alias(n)) for df, n in ((questions, "n_questions"), (items, "n_items"))]
    return counts[0].join(counts[1]).join(scored).select("n_questions", "n_items", "n_scored")


def recall(found: DataFrame, exact: DataFrame, qid: str = "query_id", iid: str = "chunk_id") -> DataFrame:
    """Share of the exact hits that were found."""
    hit = found.select(qid, iid, F.lit(1).alias("_hit"))
    return exact.join(hit, [qid, iid], "left").agg(
        F.count("*").alias("n_exact"), F.round(F.count("_hit") / F.count("*"), 4).alias("recall")
    )


def with_item_columns(hits: DataFrame, index: DataFrame, columns: list[str], qid: str = "query_id") -> DataFrame:
    """Fetch ``columns`` for the hits only; vectors and text never travel together.

    The hits (at most ``k`` per question) are written once, so the search does
    not run again for each use. The index is first cut to the chunks that were
    hit. Few hits are sent to the index instead of shuffling it. One chunk may
    be the hit of very many questions: only such chunks are copied, once per ``HOT_ROWS`` hits, so that no task gets all of them.
    """
    hits = materialise(hits, "hits")
    if hits.count() <= SENT_HITS:
        # a bounded number of ids and scores goes to all tasks; the index is scanned and stays where it is
        return index.select("chunk_id", *columns).join(F.broadcast(hits), "chunk_id")
    counts = hits.groupBy("chunk_id").agg(F.count("*").alias("n"))
    fetched = index.select("chunk_id", *columns).join(counts.select("chunk_id"), "chunk_id", "left_semi")
    hot = counts.where(F.col("n") > HOT_ROWS)
    if hot.isEmpty():
        return hits.join(fetched, "chunk_id")
    shares = hot.select("chunk_id", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_shares"))
    share = F.pmod(F.xxhash64(qid), F.coalesce("_shares", F.lit(1))).cast("int").alias("_share")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_share")
    asked = lookup(hits, shares, ["chunk_id"], qid, how="left").select(*hits.columns, share)
    copied = fetched.join(shares, "chunk_id", "left").select(*fetched.columns, every)
    return asked.join(copied, ["chunk_id", "_share"]).drop("_share")


def topk_text(
    questions: DataFrame,
    index: DataFrame,
    k: int = SEARCHED,
    columns: tuple[str, ...] = ("url", "page_title", "text"),
    text: str = "text",
    dim: int = DIM,
    qid: str = "query_id",
    **encoder,
) -> DataFrame:
    """Nearest chunks of question texts, with the asked columns."""
    asked = embed(questions.select(qid, text), text, dim, **encoder)
    hits = topk_vector(asked, index, k, qid)
    return with_item_columns(hits, index, list(columns), qid).select(qid, "rk", "score", "chunk_id", *columns)


def gather(hits: DataFrame, qid: str = "query_id") -> DataFrame:
    """One row per question with its at most ``k`` hits in rank order."""
    doc = F.struct("rk", "text", "url", "page_title", "score", "chunk_id")
    return hits.groupBy(qid).agg(F.sort_array(F.collect_list(doc)).alias("docs"))


def retrieve(questions: DataFrame, index: DataFrame, k: int = RETRIEVED, qid: str = "query_id", **kw) -> DataFrame:
    """The retriever: ``(qid, docs)`` with text, url and title of the ``k`` nearest chunks."""
    return gather(topk_text(questions, index, k, qid=qid, **kw), qid)


def result_rows(df: DataFrame, result: str = "result", qid: str = "query_id") -> DataFrame:
    """Unpack nested results ``result.data_array``; a missing result gives no rows."""
    element = df.schema[result].dataType["data_array"].dataType.simpleString()
    rows = F.coalesce(F.col(result)["data_array"], F.array().cast(element))
    return df.select(qid, F.posexplode(rows).alias("pos", "row")).select(qid, "pos", "row.*")
