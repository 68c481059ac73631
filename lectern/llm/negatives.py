"""Hard negatives by lists that the anchors of a cluster share.

A negative is hard if it scores nearly as high as a positive: between ``FLOOR``
and all of the positive's score. Scores are inner products of vectors of whole
numbers.

* Anchors are clustered by direction. Centres come from a bounded sample of
  anchors; a cluster is dealt into groups of bounded size.
* Candidates are cut into blocks of bounded size, and each group meets each
  block. There the block is sorted once for the whole group, by the bound that
  the angles give: no anchor within the angle ``t`` of the group's centre
  scores above ``|anchor| * |candidate| * cos(max(0, angle - t))``.
* Each anchor walks that one list until what is left cannot reach its result,
  which is certified by the bound, and is exact for any clustering.

The walk is taken twice. The first finds the best rows of an anchor's own
label; the best of all blocks are its positives. The second knows their scores,
so it ends where the bound falls below ``FLOOR`` of the least of them at the
latest, whatever the block holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import materialise
from .common import bounded_sample, narrow

#: Positives of an anchor, negatives of a positive, least share of a positive's score in hundredths.
POSITIVES, NEGATIVES, FLOOR = 5, 5, 80
#: Anchors that teach the centres, anchors per centre, and the most centres.
SAMPLE, PER_CENTRE, CENTRES, ROUNDS = 16_384, 128, 1024, 8
#: Anchors that share a list, such groups that one task gets, and candidates in a block.
GROUP, GROUPS, BLOCK = 1024, 64, 8192
_NONE = np.iinfo(np.int64).min
#: Scores are exact below this; larger ones count as this.
LIMIT = 1 << 49


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(row, id, label, vector) of the rows that take part, written; components are ``floor(scale * x)``.

    These are the rows with an id, a label and a vector of finite components.
    Of vectors that differ in length those of the most frequent length take part.
    """
    rows = narrow(df, id=id_col, vector=vector_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
    vector = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
    kept = rows.select("id", "label", vector.alias("vector")).where(F.coalesce(finite, F.lit(False)))
    made = materialise(
        kept.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "label", whole.alias("vector")), "vectors"
    )
    usual = made.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "n").limit(1).collect()
    return made.where(F.size("vector") == (usual[0].n if usual else 0))


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions; a zero vector has the direction zero."""
    length = np.linalg.norm(vectors, axis=1)
    return length, vectors / np.where(length > 0, length, 1)[:, None]


def centres(anchors: DataFrame) -> np.ndarray:
    """Directions around which anchors gather: spherical k-means over at most ``SAMPLE`` anchors, the same in every run."""
    n = anchors.count()
    k = max(1, min(CENTRES, n // PER_CENTRE))
    rows = bounded_sample(anchors.select("id", "vector"), min(SAMPLE, max(k, n)), "id", "vector").toArrow()
    if k == 1 or not rows.num_rows:
        return np.zeros((1, 0))
    unit = _units(_numbers(rows.column("vector")))[1]
    found = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(unit @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 0, sums / np.where(length > 0, length, 1), found)
    return found


def clustered(anchors: DataFrame, around: np.ndarray) -> DataFrame:
    """``anchors`` with their ``cluster``, the nearest centre."""
    schema = T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())])
    if len(around) == 1:
        return anchors.withColumn("cluster", F.lit(0))
    sent = anchors.sparkSession.sparkContext.broadcast(around)
    at = anchors.columns.index("vector")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = np.argmax(_units(_numbers(batch.column(at)))[1] @ sent.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=schema.names)

    return anchors.mapInArrow(run, schema)


class SharedList:
    """A block in the order in which all anchors of a group walk it."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        length, unit = _units(anchors)
        centre = unit.sum(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 0 else centre
        spread = np.arccos(np.clip(unit @ centre, -1, 1)).max(initial=0)
        held, direction = _units(vectors)
        angle = np.arccos(np.clip(direction @ centre, -1, 1))
        bound = held * np.cos(np.maximum(0, angle - spread))
        by = np.lexsort((ids, -bound))
        self.anchors, self.length = anchors, length
        self.ids, self.vectors, self.labels, self.rows = ids[by], vectors[by], labels[by], rows[by]
        # above what rounding may take from a bound
        self.bound = bound[by] + 1e-6 * held[by] + 1e-9
        # equal ids keep their order, so each place in the block has a rank of its own
        self.by_rank = np.lexsort((np.arange(len(by)), self.ids))[::-1]
        self.rank = np.empty(len(by), dtype=np.int64)
        self.rank[self.by_rank] = np.arange(len(by))

    def best(self, allowed, floor: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """(anchor, wish, place, score) of the ``most`` best candidates for each wish of each anchor.

        ``allowed(anchors, places, scores)`` gives wish by wish which
        candidates count, and ``floor`` (anchors x wishes) the scores below
        which none does. Equal scores are ordered by id.

        A key holds the score and, below it, the rank by id, so keys in
        descending order are the asked order. An anchor leaves once, for each
        wish, the bound of what is left lies below its floor or below the last
        of ``most`` finds.
        """
        n, wishes = len(self.ids), floor.shape[1]
        top = np.full((len(self.anchors), wishes, most), _NONE)
        alive, at, step = np.arange(len(self.anchors)), 0, 256
        while at < n and len(alive):
            to = min(n, at + step)
            product = self.anchors[alive] @ self.vectors[at:to].T
            score = np.clip(np.nan_to_num(product), -LIMIT, LIMIT).astype(np.int64)
            keys = score * n + self.rank[at:to]
            ceiling = self.length[alive] * self.bound[to] if to < n else np.full(len(alive), -np.inf)
            done = np.ones(len(alive), dtype=bool)
            for wish, counts in enumerate(allowed(alive, slice(at, to), score)):
                both = np.concatenate([top[alive, wish], np.where(counts, keys, _NONE)], axis=1)
                held = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
                top[alive, wish] = held
                least = held.min(axis=1)
                done &= (ceiling < floor[alive, wish]) | ((least != _NONE) & (ceiling < least // n))
            alive, at, step = alive[~done], to, min(4096, 2 * step)
        anchor, wish, _ = found = np.nonzero(top != _NONE)
        keys = top[found]
        return anchor, wish, self.by_rank[keys % n], keys // n


def _search(groups: DataFrame, items: DataFrame, n_blocks: int, n_tasks: int, wanted: str, prepare) -> DataFrame:
    """(row, wish, id, score): the best of every block of candidates for every anchor.

    A task gets up to ``GROUPS`` groups of anchors and one block. So a
    candidate moves once per ``GROUP * GROUPS`` anchors, an anchor once per
    block. ``prepare(shared list, anchors)`` gives what ``best`` asks for.
    """
    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = groups.select("row", "label", "vector", "group", wanted, (F.expr(f"group div {GROUPS}")).cast("int").alias("task"), each(n_blocks).alias("block"))
    right = items.select("row", "id", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), each(n_tasks).alias("task"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("wish", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        made = []
        if anchors.num_rows and block.num_rows:
            rows, ids = (block.column(c).to_numpy() for c in ("row", "id"))
            labels, vectors = block.column("label").to_numpy(), _numbers(block.column("vector"))
            number = anchors.column("group").to_numpy()
            for group in np.unique(number):
                mine = anchors.filter(pa.array(number == group))
                shared = SharedList(_numbers(mine.column("vector")), ids, vectors, labels, rows)
                anchor, wish, place, score = shared.best(*prepare(shared, mine))
                made.append(pa.Table.from_arrays(
                    [pa.array(mine.column("row").to_numpy()[anchor]), pa.array(wish, pa.int32()), pa.array(shared.ids[place]), pa.array(score)], schema=arrow
                ))
        return pa.concat_tables(made) if made else arrow.empty_table()

    return left.groupBy("task", "block").cogroup(right.groupBy("task", "block")).applyInArrow(run, schema)


def _own_label(shared: SharedList, anchors: pa.Table) -> tuple:
    """Other rows of the anchor's label; any score will do."""
    label, row = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()

    def allowed(alive: np.ndarray, places: slice, score: np.ndarray) -> list[np.ndarray]:
        return [(label[alive, None] == shared.labels[None, places]) & (row[alive, None] != shared.rows[None, places])]

    return allowed, np.full((len(label), 1), -np.inf), POSITIVES


def _below_positives(shared: SharedList, anchors: pa.Table) -> tuple:
    """Rows of other labels that score at most as a positive does, and ``FLOOR`` hundredths of it at least."""
    label = anchors.column("label").to_numpy()
    above = np.full((len(label), POSITIVES), -1, dtype=np.int64)  # below zero nothing can count
    for i, scores in enumerate(anchors.column("scores").to_pylist()):
        above[i, : len(scores)] = scores
    floor = np.where(above >= 0, FLOOR * above / 100, np.inf)

    def allowed(alive: np.ndarray, places: slice, score: np.ndarray) -> list[np.ndarray]:
        other = label[alive, None] != shared.labels[None, places]
        return [
            other & (score <= most[:, None]) & (100 * score >= FLOOR * most[:, None]) & (most[:, None] >= 0)
            for most in above[alive].T
        ]

    return allowed, floor, NEGATIVES


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of what all blocks found, with their place from 1."""
    order = Window.partitionBy("row", "wish").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mine(
    df: DataFrame, anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id meets the SQL condition ``anchor`` on ``id``.
    An anchor's positives are the ``POSITIVES`` best other rows of its label;
    for each of them come the ``NEGATIVES`` best rows of other labels that
    score at least ``FLOOR`` hundredths of it and not more than it. Higher
    scores come first, then smaller ids.

    Rows without an id or a label, and those whose vector is null, empty or has
    a null or non-finite component, take no part; ``quantised`` says more.
    Repeated rows and ids are rows of their own, so a copy of an anchor is one
    of its other rows. An empty table, or one without an anchor, gives no row.
    """
    items = quantised(df, id_col, vector_col, label_col, scale)
    chosen = items.where(anchor)
    centred = materialise(clustered(chosen, centres(chosen)), "anchors")
    sizes = {r.cluster: -(-r.n // GROUP) for r in centred.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # CENTRES rows at most
    offsets, n_groups = {}, 0
    for cluster in sorted(sizes):
        offsets[cluster] = n_groups
        n_groups += sizes[cluster]
    n_blocks, n_tasks = max(1, -(-items.count() // BLOCK)), max(1, -(-n_groups // GROUPS))
    named = items.sparkSession.createDataFrame([(c, offsets[c], sizes[c]) for c in sizes], "cluster int, offset int, parts int")
    group = (F.col("offset") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("group")
    groups = centred.join(F.broadcast(named), "cluster").select("row", "id", "label", "vector", group)

    positives = materialise(
        _ranked(_search(groups.withColumn("scores", F.lit(None).cast("array<long>")), items, n_blocks, n_tasks, "scores", _own_label), POSITIVES)
        .select("row", (F.col("place") - 1).alias("wish"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )
    scores = positives.groupBy("row").agg(F.sort_array(F.collect_list("positive_score"), asc=False).alias("scores"))  # POSITIVES at most
    asked = groups.join(scores, "row")
    found = _ranked(_search(asked, items, n_blocks, n_tasks, "scores", _below_positives), NEGATIVES)
    names = centred.select("row", F.col("id").alias("anchor_id"))
    return (
        found.select("row", "wish", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(positives, ["row", "wish"])
        .join(names, "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
