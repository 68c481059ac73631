"""Language-model scores by prediction by partial matching over bytes.

The model counts which byte follows each context of up to ``ORDER`` bytes in
all training texts. A byte is coded in its longest known context; if it was
not seen there, an escape (method C) leads to the next shorter context, where
the symbols already ruled out are excluded. With fixed counts everything that
exclusion needs is a sum per context, so the trie is kept as sorted arrays,
one level per order, and whole batches of bytes are scored with lookups.

Every counted gram is in the model. Only grams of at least 2^-``HEAD_BITS`` of
the training bytes travel with the tasks, each with its final value, which is
at most 2^``HEAD_BITS`` of them for any corpus; what else a text holds is
joined. The values of those grams are found in groups of equal last context
bytes: all that a group backs off to is in the group, or of order ``LOW`` at
most, and such short contexts are the same few for every corpus. The word counts
of the base score are split the same way, by 2^-``SHARE_BITS``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import narrow

ORDER, SHARE_BITS, HEAD_BITS = 5, 20, 22
#: Longest context of which every task that finds values has all counts.
LOW = 2
#: Bytes that no UTF-8 text contains: before its start, and its end.
PAD, END = 0xFE, 0xFF
#: Bytes coded at once; a longer text is coded in pieces that see the bytes before.
PIECE = 1 << 20
#: Bytes of texts that are looked at together.
SLICE = 1 << 20
#: Grams that are valued together, if their groups allow it.
GROUP = 1 << 19
#: Distinct words and grams that a task keeps before it passes them on.
HELD_WORDS, HELD_GRAMS = 250_000, 1_000_000
_COUNTS = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower()


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place, lower-case texts) of a column, about ``SLICE`` bytes at a time."""
    texts, at, size = [], 0, 0
    for value in column:
        texts.append(lowered(value.as_py()))
        size += len(texts[-1])
        if size >= SLICE:
            yield at, texts
            texts, at, size = [], at + len(texts), 0
    if texts:
        yield at, texts


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, number of the text) for groups of about ``PIECE`` bytes; a gram is a byte and the ``ORDER`` before it."""
    start, held, owners, size = bytes([PAD]) * ORDER, [], [], 0

    def grams() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.int64)
        lengths = np.array([len(h) for h in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        coded = np.ones(len(data), dtype=bool)
        for at in range(ORDER):
            coded[starts + at] = False
        keys = np.zeros(len(data) - ORDER, dtype=np.int64)
        for at in range(ORDER + 1):
            keys = keys << 8 | data[at : at + len(keys)]
        return keys[coded[ORDER:]], np.repeat(np.array(owners), lengths - ORDER)

    for number, text in enumerate(texts):
        whole = start + text + bytes([END])
        for at in range(0, len(whole) - ORDER, PIECE):
            held.append(whole[at : at + PIECE + ORDER])
            owners.append(number)
            size += len(held[-1])
            if size >= PIECE:
                yield grams()
                held, owners, size = [], [], 0
    if held:
        yield grams()


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts).astype(float), len(distinct)).astype(np.int64)


def count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, gram, n) of all texts of ``df``, written; a row has a word or a gram, the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts = [], []

        def out_words() -> pa.RecordBatch:
            n = len(words)
            columns = [pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

        def out_grams() -> pa.RecordBatch:
            columns = [pa.nulls(len(keys[0]), pa.binary()), pa.array(keys[0]), pa.array(counts[0])]
            return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

        for _, texts in (x for batch in batches for x in slices(batch.column(0))):
            for text in texts:
                words.update(text.split())
                words[b""] += 1
                if len(words) > HELD_WORDS:
                    yield out_words()
                    words.clear()
            for grams, _ in pieces(texts):
                found, n = np.unique(grams, return_counts=True)
                keys.append(found)
                counts.append(n)
                if len(keys) >= 4:
                    merged = _merged(keys, counts)
                    keys, counts = [merged[0]], [merged[1]]
                    if len(keys[0]) > HELD_GRAMS:
                        yield out_grams()
                        keys, counts = [], []
        if keys:
            merged = _merged(keys, counts)
            keys, counts = [merged[0]], [merged[1]]
            yield out_grams()
        if words:
            yield out_words()

    parts = narrow(df, text=text_col).mapInArrow(run, "word binary, gram long, n long")
    return materialise(parts.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")


class Trie:
    """The contexts of each order and what each may be followed by, as sorted arrays of log10 values."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        """nodes: (keys, counts) of kept (context, byte) per order; contexts: (keys, counts) of all that follows, per order."""
        self.keys, self.log, self.context = [], [], []
        self.total, self.escape, self.room, self.escape_excluded = [], [], [], []
        rest, kinds, seen_counts = [], [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for order, ((keys, counts), (above, n)) in enumerate(zip(nodes, contexts, strict=True)):
                at = np.searchsorted(above, keys >> 8)
                kept = np.bincount(at, counts, len(above))
                t = np.bincount(at, minlength=len(above)).astype(float)
                self.keys.append(keys)
                self.context.append(above)
                self.log.append(np.log10(counts))
                self.total.append(np.log10(n + t))
                self.escape.append(np.log10(t + n - kept) - self.total[-1])
                rest.append(n - kept)
                kinds.append(t)
                seen_counts.append((counts, n))
                if order:  # what the next shorter context offers when the bytes seen here are excluded
                    shorter = above & ((1 << 8 * (order - 1)) - 1)
                    p = np.searchsorted(self.context[order - 1], shorter)
                    same = np.searchsorted(self.keys[order - 1], keys & ((1 << 8 * order) - 1))
                    excluded = np.bincount(at, seen_counts[order - 1][0][same], len(above))
                    left = kinds[order - 1][p] - t
                    room = seen_counts[order - 1][1][p] - excluded + left
                    self.room.append(np.log10(room))
                    self.escape_excluded.append(np.where(room > 0, np.log10(left + rest[order - 1][p]) - np.log10(room), 0.0))
                else:
                    self.room.append(np.zeros(len(above)))
                    self.escape_excluded.append(np.zeros(len(above)))
        self.unseen = -np.log10(256 - (kinds[0][0] if len(kinds[0]) else 0))
        if len(nodes[-1][0]):
            self.direct = self.log[-1] - self.total[-1][np.searchsorted(self.context[-1], self.keys[-1] >> 8)]

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        order = len(self.keys) - 1
        at, hit = self._find(self.keys[order], grams)
        out = np.zeros(len(grams))
        if hit.any():
            out[hit] = self.direct[at[hit]]
        rows = np.flatnonzero(~hit)  # those left; each has its cost so far and the context that it escaped from
        grams, cost, child = grams[rows], np.zeros(len(rows)), np.full(len(rows), -1)
        for k in range(order, -1, -1):
            context, known = self._find(self.context[k], (grams >> 8) & ((1 << 8 * k) - 1))
            node, found = self._find(self.keys[k], grams & ((1 << 8 * (k + 1)) - 1))
            first, later = known & (child < 0), known & (child >= 0)
            done = found & known
            price = np.zeros(len(rows))
            price[first] = np.where(done[first], self.log[k][node[first]] - self.total[k][context[first]], self.escape[k][context[first]])
            if later.any():
                came = child[later]
                price[later] = np.where(done[later], self.log[k][node[later]] - self.room[k + 1][came], self.escape_excluded[k + 1][came])
            cost = cost + price
            out[rows[done]] = cost[done]
            child = np.where(known, context, child)
            rows, grams, cost, child = rows[~done], grams[~done], cost[~done], child[~done]
        out[rows] = cost + self.unseen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        sums = np.zeros(len(texts))
        for grams, owner in pieces(texts):
            sums += np.bincount(owner, self.log_probabilities(grams), len(texts))
        return sums


def _level(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Nodes and contexts of one order of counted grams."""
    keys, counts = _merged([grams & ((1 << 8 * (order + 1)) - 1)], [n])
    above, sums = _merged([keys >> 8], [counts])
    return (keys, counts.astype(float)), (above, sums.astype(float))


def head(grams: DataFrame, head_bits: int = HEAD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(grams, log10 probabilities) of the counted grams that are frequent enough to travel, sorted."""
    total = grams.agg(F.sum("n").alias("n")).first().n or 0
    contexts = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
    frequent = grams.where(F.col("n") >= F.lit(total / 2.0**head_bits)).withColumn("context", F.shiftright("gram", 8))
    value = F.log10("n") - F.log10(F.col("whole") + F.col("kinds"))
    rows = frequent.join(contexts, "context").select("gram", value.alias("value")).toArrow()
    keys, values = (rows.column(c).to_numpy() for c in ("gram", "value"))
    by = np.argsort(keys)
    return keys[by], values[by]


def values(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, value) of each row of ``asked`` (gram), distinct and written: its log10 probability by all counts of ``grams``."""
    known = F.expr(f"gram & {(1 << 8 * (LOW + 1)) - 1}L")
    rows = grams.groupBy(known.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = (rows.column(c).to_numpy() for c in ("gram", "n"))
    low = [_level(keys, n, order) for order in range(LOW + 1)]

    def valued(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Values of whole groups of grams."""
        levels = [*low, *[_level(keys[n > 0], n[n > 0], order) for order in range(LOW + 1, ORDER + 1)]]
        model = Trie([nodes for nodes, _ in levels], [contexts for _, contexts in levels])
        asked = np.sort(keys[wanted])
        for at in range(0, len(asked), PIECE):
            some = asked[at : at + PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(model.log_probabilities(some))], ["gram", "value"])

    mask = (1 << 8 * (LOW + 1)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; as many as make a piece are valued together."""
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for batch in batches:
            for column, values in zip(held, batch.columns, strict=True):
                column.append(values.to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= GROUP:
                columns = [np.concatenate(c) for c in held]
                group = columns[0] >> 8 & mask
                ends = np.flatnonzero(group[1:] != group[:-1]) + 1
                if len(ends):
                    yield from valued(*(c[: ends[-1]] for c in columns))
                    columns = [c[ends[-1] :] for c in columns]
                held, size = [[c] for c in columns], len(columns[0])
        if size:
            yield from valued(*(np.concatenate(c) for c in held))

    counted = grams.select("gram", "n", F.lit(False).alias("asked"))
    every = counted.unionByName(asked.select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    one = every.groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    context = F.expr(f"shiftright(gram, 8) & {(1 << 8 * (LOW + 1)) - 1}L")  # such a group has at most 2^24 grams
    return materialise(one.repartition(context).sortWithinPartitions(context).mapInArrow(run, "gram long, value double"), "values")


def trie(counts: DataFrame, share_bits: int = SHARE_BITS) -> Trie:
    """The trie of the counted grams of at least 2^-share_bits of all bytes; the rest is escape mass."""
    grams = counts.where("gram IS NOT NULL")
    total = grams.agg(F.sum("n").alias("n")).first().n or 0
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    levels = grams.select("gram", "n", orders.alias("k")).select(
        "k", F.expr("gram & (shiftleft(1L, 8 * (k + 1)) - 1)").alias("key"), "n"
    )
    nodes = levels.groupBy("k", "key").agg(F.sum("n").alias("n"))
    kept = F.col("n") >= F.lit(total / 2.0**share_bits)
    contexts = nodes.groupBy("k", F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("n"), F.collect_list(F.when(kept, F.struct("key", "n"))).alias("followed")
    )
    rows = contexts.where(F.size("followed") > 0).toArrow()  # a list holds a context's bytes, 256 at most
    k, context, n = (rows.column(c).to_numpy() for c in ("k", "context", "n"))
    lists = rows.column("followed").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(k)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    key, m = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
    per_node, per_context = [], []
    for order in range(ORDER + 1):
        mine, own = k == order, k[owner] == order if len(owner) else np.zeros(0, dtype=bool)
        by, of = np.argsort(key[own]), np.argsort(context[mine])
        per_node.append((key[own][by], m[own][by].astype(float)))
        per_context.append((context[mine][of], n[mine][of].astype(float)))
    return Trie(per_node, per_context)


def score(
    df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", share_bits: int | None = None,
    head_bits: int = HEAD_BITS,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of ``df``, learnt from all rows of ``training``.

    ``base_score`` is the smoothed unigram log10 probability of the words and
    the end; ``score`` is the trie's of all bytes and the end. A null text is
    empty. Rows with equal id and text are equal, and repeat. Without training
    rows every byte has the same probability. With ``share_bits`` the trie is
    the smaller one of the grams that have that share; by default all count.
    """
    counts = count(training, text_col)
    grams = counts.where("gram IS NOT NULL").select("gram", "n")
    model = None if share_bits is None else trie(counts, share_bits)
    known_grams, known_values = head(grams, head_bits) if model is None else (None, None)
    share_bits = SHARE_BITS if share_bits is None else share_bits
    words = counts.where("word IS NOT NULL").select("word", "n")
    whole = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    n, v, ends = whole.n or 0, whole.v, whole.ends or 0
    spread = n + 0.5 * (v + 1)
    frequent = words.where(F.col("n") >= F.lit(max(1.0, n / 2.0**share_bits))).where(F.length("word") > 0)
    common = {bytes(r.word): float(np.log10((r.n + 0.5) / spread)) for r in frequent.collect()}
    end_score = float(np.log10((ends + 0.5) / spread))
    schema = (
        f"id {dict(df.dtypes)[id_col]}, print long, n_tokens long, known long, base double, score double, "
        "rare array<struct<word:binary,times:int>>, tail array<struct<gram:long,times:int>>"
    )

    def by_head(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Sums of the values at hand; all other grams of each text and how often it has them."""
        sums, parts = np.zeros(len(texts)), [np.zeros((3, 0), dtype=np.int64)]
        for found, owner in pieces(texts):
            # each gram is looked up once, and in order, which is what memory likes best
            distinct, where = np.unique(found, return_inverse=True)
            at, hit = Trie._find(known_grams, distinct)
            value = np.zeros(len(distinct))
            value[hit] = known_values[at[hit]]
            sums += np.bincount(owner, value[where], len(texts))
            others, number, rest = distinct[~hit], np.cumsum(~hit) - 1, ~hit[where]
            pairs, times = np.unique(owner[rest] * len(others) + number[where[rest]], return_counts=True)
            if len(pairs):
                parts.append(np.stack([pairs // len(others), others[pairs % len(others)], times]))
        owner, gram, times = np.concatenate(parts, axis=1)  # in the order of the texts
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        listed = pa.StructArray.from_arrays([pa.array(gram), pa.array(times.astype(np.int32))], ["gram", "times"])
        return sums, pa.ListArray.from_arrays(pa.array(offsets), listed)

    def by_trie(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        tail_type = pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int32())]))
        return model.score(texts), pa.nulls(len(texts), tail_type)

    sums_and_tails = by_head if model is None else by_trie

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts in ((b, at, texts) for b in batches for at, texts in slices(b.column(2))):
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split])
            numbers: dict[bytes, int] = {}
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64, int(counts.sum()))
            del split
            value = np.fromiter((common.get(w, np.nan) for w in numbers), float, len(numbers))[flat]
            owner, found = np.repeat(np.arange(len(texts)), counts), ~np.isnan(value)
            base = end_score + np.bincount(owner[found], value[found], len(texts))
            known = int(ends > 0) + np.bincount(owner[found], minlength=len(texts))
            pairs, times = np.unique(owner[~found] * len(numbers) + flat[~found], return_counts=True)
            of, which = (pairs // len(numbers), pairs % len(numbers)) if len(pairs) else (pairs, pairs)
            others = pa.StructArray.from_arrays(
                [pa.array(list(numbers), pa.binary()).take(pa.array(which)), pa.array(times.astype(np.int32))], ["word", "times"]
            )
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), others)
            scores, tails = sums_and_tails(texts)
            columns = [pa.array(counts + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(scores), rare, tails]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(at, len(texts)) for c in (0, 1)), *columns], ["id", "print", "n_tokens", "known", "base", "score", "rare", "tail"]
            )

    rows = narrow(df, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("print"), "text")
    scored = materialise(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("id", "print", F.explode("rare").alias("r")).select("id", "print", "r.word", "r.times")
    found = rare.join(words.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    value = F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(float(spread)))
    parts = found.select(
        "id", "print", F.lit(0).alias("row"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("score"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("known"), value.alias("base"),
    )
    heads = scored.select("id", "print", F.lit(1).alias("row"), "n_tokens", "score", "known", "base").unionByName(parts)
    if model is None:
        tails = scored.select("id", "print", F.explode("tail").alias("t")).select("id", "print", "t.gram", "t.times")
        valued = tails.join(values(grams, scored.select(F.explode("tail.gram").alias("gram"))), "gram")
        heads = heads.unionByName(
            valued.select(
                "id", "print", F.lit(0).alias("row"), F.lit(None).cast("long").alias("n_tokens"),
                (F.col("times") * F.col("value")).alias("score"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"),
            )
        )
    together = heads.groupBy("id", "print").agg(
        F.sum("row").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.sum("score").alias("score"),
        F.sum("known").alias("known"), F.sum("base").alias("base"),
    )
    return together.select(
        F.col("id").alias(id_col), "n_tokens", F.expr("known div rows").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"),
    ).drop("row")
