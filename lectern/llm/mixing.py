"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots. Slot ``i`` has the point ``i * golden ratio``
modulo 1; the source on whose stretch of the cumulative targets the point falls
owns the slot, so that each source comes up evenly. Slots are ranked per
source, and the slot of rank ``r`` takes the ``r``-th block of the source's
documents, which are shuffled by a hash and cut into as many blocks as the
source has slots, equal but for one word. A source of which more is wanted than
it has begins again.

All of it is joins, windows and aggregates; running numbers are built from
counts per bucket, so no window holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import WORD

#: Weights of the sources in their order, repeating; the mix's size and a source's largest share, in sizes.
WEIGHTS, TOTAL, REPEATS = (5, 2, 1), 1.5, 2
#: Words in a slot, about: each source's blocks are sized so that its slots meet its target.
BLOCK = 1024
#: Points are multiples of the golden ratio on a ring of 2^31; sources are looked up in 2^12 cells of it.
RING, STEP, CELL_BITS = 1 << 31, 1327217885, 19
#: Slots are ranked in runs of 2^16.
RUN_BITS = 16


@dataclass
class Mix:
    """``documents``: id, source, size, source_size, target, src, start. ``spans``: slot, src, start, cycle, from_word, to_word.

    A span is the part of a document that a slot takes; (src, start) names the
    document, as the stream of a source has one document at each word.
    """

    documents: DataFrame
    spans: DataFrame


def targets(sources: DataFrame) -> DataFrame:
    """Rows (src, source, source_size) with their rank, weight and target.

    Sharing again what is above the limits until nothing is ends at one level:
    every target is the smaller of its limit and weight times the level. Sorted
    by limit per weight, the level is the first one that its own source does
    not fall below. There is a row per source, in one window.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (TOTAL * F.sum("source_size").over(everything) - F.coalesce(REPEATS * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= REPEATS * F.col("source_size")
    turn = F.row_number().over(by_limit)
    return (
        leveled.withColumn("turn", turn)
        .withColumn("found", F.min(F.when(fits, F.struct("turn", "level"))).over(everything))
        .withColumn("target", F.round(F.least((REPEATS * F.col("source_size")).cast("double"), F.col("found.level") * F.col("weight")), 6))
        .select("src", "source", "source_size", "rank", "weight", "target")
    )


def _slots(sources: DataFrame, n: int) -> DataFrame:
    """(slot, src) for the slots 0 to n - 1; a cell meets the few sources whose stretch touches it."""
    spark = sources.sparkSession
    point = (F.col("id") % RING) * STEP % RING
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.shiftright(point, CELL_BITS).alias("cell"))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("target").over(Window.partitionBy())
    end = F.floor(F.round(F.sum("target").over(upto) / whole, 12) * RING)
    stretch = (
        sources.where("target > 0")
        .withColumn("end", end)
        .withColumn("begin", F.coalesce(F.lag("end").over(Window.orderBy("rank")), F.lit(0)))
        .where("begin < end")
    )
    cells = stretch.select("src", "begin", "end", F.explode(F.sequence(F.shiftright("begin", CELL_BITS), F.shiftright(F.col("end") - 1, CELL_BITS))).alias("cell"))
    return slots.join(cells, "cell").where("point >= begin AND point < end").select("slot", "src")


def _ranked(slots: DataFrame) -> DataFrame:
    """Slots with their rank within the source, from 0, counted run by run."""
    runs = slots.withColumn("run", F.shiftright("slot", RUN_BITS))
    counts = runs.groupBy("src", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("src", "run").orderBy("slot"))
    return runs.join(offsets, ["src", "run"]).select("slot", "src", (F.col("offset") + within - 1).alias("block"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", identity: Column | None = None
) -> Mix:
    """Mix all rows of ``df``.

    ``identity`` tells rows of one id apart in ``print``, by default the text.

    A document's size is its words; null and empty texts have none, are not
    taken, and keep their row. A null source is a source, the last one. Rows
    with equal ids are documents of their own; equal rows are interchangeable.
    An empty table gives an empty mix. A source too small to meet a point gets
    one slot at the end.
    """
    mark = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    given = [F.col(f"`{old}`").alias(new) for new, old in (("id", id_col), ("text", text_col), ("source", source_col))]
    documents = materialise(
        df.select(*given, (F.xxhash64(F.col(f"`{text_col}`")) if identity is None else identity).alias("print")).select(
            "id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
            words(F.col("text")).alias("size"),
            "print",
            mark.alias("mark"),
            F.substring(mark, 1, 3).alias("bucket"),
        ),
        "sized",
    )
    cells = documents.groupBy("src", "source", "bucket").agg(F.sum("size").alias("size"))
    sources = materialise(targets(cells.groupBy("src", "source").agg(F.sum("size").alias("source_size"))), "sources")
    total = sources.agg(F.sum("target").alias("n")).first().n or 0.0
    n_slots = int(-(-total // BLOCK))
    slots = materialise(_slots(sources, n_slots), "slots")
    unmet = sources.where("target >= 1").join(slots.select("src").distinct(), "src", "left_anti")
    slots = slots.unionByName(unmet.select((n_slots + F.col("rank")).cast("long").alias("slot"), "src"))
    per_source = slots.groupBy("src").agg(F.count("*").alias("n_slots"))
    # the words wanted of a source fill all its slots: the first of them, ``longer`` in number, take one more than the others
    wanted = F.floor("target")
    sized = sources.join(per_source, "src", "left").select(
        "src", "source_size", "target", F.expr("floor(target) div n_slots").alias("block_words"), (wanted % F.col("n_slots")).alias("longer")
    )
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("src", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")).join(sized, "src")
    within = Window.partitionBy("src", "bucket").orderBy("mark", "id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(
        documents.join(offsets, ["src", "bucket"]).select(
            "id", "source", "src", "size", "print", "source_size", "target", "block_words", "longer",
            (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start"),
        ),
        "placed",
    )
    begin = F.col("start") + F.col("cycle") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.floor("target"))
    long_ones = "longer * (block_words + 1)"

    def block(word: str) -> str:
        """The block that a word of the source is in."""
        return f"CASE WHEN {word} < {long_ones} THEN {word} div (block_words + 1) ELSE longer + ({word} - {long_ones}) div block_words END"

    first_word = F.col("block") * F.col("block_words") + F.least("block", "longer")
    next_first = (F.col("block") + 1) * F.col("block_words") + F.least(F.col("block") + 1, "longer")
    pieces = (
        placed.where("size > 0 AND block_words + longer > 0")
        .select("src", "start", "size", "source_size", "target", "block_words", "longer", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("cycle"))
        .select("src", "start", "cycle", "block_words", "longer", begin.alias("begin"), end.alias("end"))
        .where("begin < end")
        .select("*", F.explode(F.expr(f"sequence({block('begin')}, {block('(end - 1)')})")).alias("block"))
        .select(
            "src", "start", "cycle", "block",
            (F.greatest("begin", first_word) - F.col("begin")).alias("from_word"),
            (F.least("end", next_first) - F.col("begin")).alias("to_word"),
        )
    )
    spans = pieces.join(_ranked(slots), ["src", "block"]).select("slot", "src", "start", "cycle", "from_word", "to_word")
    return Mix(placed, spans)


def taken(mixed: Mix) -> DataFrame:
    """id, source, size, source_size, target, taken (words that the slots take), copies (takes of its first word)."""
    sums = mixed.spans.groupBy("src", "start").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.sum(F.when(F.col("from_word") == 0, 1).otherwise(0)).alias("copies"),
    )
    columns = ["id", "source", "size", "source_size", "target", "taken", "copies", "print"]
    some = mixed.documents.where("size > 0").join(sums, ["src", "start"], "left").fillna(0, ["taken", "copies"])
    none = mixed.documents.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(0).cast("long")})
    return some.select(columns).unionByName(none.select(columns))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as often as the mix takes their first word: not at all, once or twice; columns unchanged.

    They come in the order of the slots, so what is written is the mixed
    sequence. Documents without a word are in no block and stay out. Equal rows
    are one row that the mix takes several times; ``df`` has no map column, as
    maps cannot be compared.
    """
    whole = F.xxhash64(F.struct("*"))
    mixed = mix(df, id_col, text_col, source_col, whole)
    first = mixed.spans.where("from_word = 0").select("slot", "cycle", "src", "start")
    takes = first.join(mixed.documents.where("size > 0").select("id", "print", "src", "start"), ["src", "start"])
    worded = df.where(F.coalesce(F.col(f"`{text_col}`").rlike(WORD), F.lit(False)))
    rows = worded.select(F.struct("*").alias("row"), whole.alias("print"), F.col(f"`{id_col}`").alias("id"))
    # only rows that repeat need a representative, so only they are sorted with their texts
    again = mixed.documents.where("size > 0").groupBy("id", "print").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select("id", "print"), "repeated")
    same = F.col("rows.id").eqNullSafe(F.col("again.id")) & (F.col("rows.print") == F.col("again.print"))

    def which(how: str) -> DataFrame:
        return rows.alias("rows").join(again.alias("again"), same, how).select("rows.*")

    single = which("left_anti").unionByName(which("left_semi").groupBy("id", "print").agg(F.first("row").alias("row")).select("row", "print", "id"))
    met = F.col("one.id").eqNullSafe(F.col("takes.id")) & (F.col("one.print") == F.col("takes.print"))
    joined = single.alias("one").join(takes.alias("takes"), met).select("one.row", "takes.slot", "takes.cycle", "takes.start")
    return joined.orderBy("slot", "cycle", "start").select("row.*")
