"""Token counts by the merge ranks of a byte-pair vocabulary.

A text is divided into words, and the bytes of a word are merged pair by pair,
the pair of the lowest rank first. Merges never cross words, so each distinct
word of a table is merged once, wherever it occurs, and its number of tokens is
sent to the texts that have it, if it is frequent, and else joined to them.

Vocabularies are read, not learnt: a file has a token in base 64 and its rank on
each line. Files of that form are public for several models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: How texts are divided into words, a fixed value: contractions, letters, numbers, other signs, blanks.
DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Java, where ``\s`` is less than the blanks of Unicode.
_JAVA = DIVISION.replace(r"\s\p{L}", r"\p{IsWhite_Space}\p{L}").replace(r"(?!\S)", r"(?!\P{IsWhite_Space})").replace(r"\s+", r"\p{IsWhite_Space}+")

#: Words of at least one in 2^SENT_BITS go to all tasks; words of texts that are looked at together.
SENT_BITS, SLICE = 18, 1 << 18

Ranks = dict[bytes, int]


def read_ranks(spark: SparkSession, path: str) -> Ranks:
    """The vocabulary of a file; its size does not depend on the data."""
    line = F.split("value", " ")
    rows = spark.read.text(path).where("value <> ''").select(F.unbase64(line[0]).alias("token"), line[1].cast("int").alias("rank"))
    return {bytes(r.token): r.rank for r in rows.collect()}


def merged(word: bytes, ranks: Ranks) -> list[bytes]:
    """The tokens of a word: of all neighbours the pair of the lowest rank is joined, the first of equal ones, while there is one."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
        if not pairs:
            return parts
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def _sizes(said: DataFrame, ranks: Ranks) -> DataFrame:
    """``(word, times, n)`` of all distinct words of the arrays ``said``, written: how often each occurs, and its tokens."""
    sent = said.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(merged(w.encode(), sent.value)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], ["word", "times", "n"])

    # words combine in each task before the shuffle
    counted = said.select(F.explode("said").alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    return materialise(counted.mapInArrow(run, "word string, times long, n int"), "sizes")


def subword_counts(df: DataFrame, ranks: Ranks, key: str, text: str, sent_bits: int = SENT_BITS) -> DataFrame:
    """``(key, n_tokens)``, one row per row of ``df``, whose ``key`` does not repeat; NULL text has NULL tokens, an empty one none.

    The tokens of words that are at least one in 2^``sent_bits`` of all, so no
    more than 2^``sent_bits`` words, go to every task. The other words of a text
    are joined, and as they are rare, no word is a large part of the join.
    """
    said = df.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.col(text), F.lit(_JAVA), F.lit(0)).alias("said"))
    sized = _sizes(said, ranks)
    whole = sized.agg(F.sum("times").alias("n")).first().n or 0
    often = sized.where(F.col("times") >= F.lit(whole / 2.0**sent_bits)).select("word", "n").toArrow().combine_chunks()
    sent = df.sparkSession.sparkContext.broadcast((pa.array(often.column("word").to_pylist(), pa.string()), often.column("n").to_numpy()))
    kind = df.schema[key].dataType.simpleString()

    def counted(keys: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        known, tokens = sent.value
        words, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        hit = at >= 0
        n = np.bincount(row[hit], tokens[at[hit]], len(lists)).astype(np.int64)
        rest = words.filter(pa.array(~hit)).dictionary_encode()
        pairs, times = np.unique(row[~hit] * max(1, len(rest.dictionary)) + rest.indices.to_numpy(), return_counts=True)
        of, which = np.divmod(pairs, max(1, len(rest.dictionary)))
        rare = pa.StructArray.from_arrays([rest.dictionary.take(pa.array(which)), pa.array(times.astype(np.int32))], ["word", "times"])
        offsets = np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), rare)], ["key", "n", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            begin = 0
            while begin < len(lists):  # some rows at a time, one at least
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
                yield counted(batch.column(0).slice(begin, end - begin), lists.slice(begin, end - begin))
                begin = end

    looked = materialise(said.mapInArrow(run, f"key {kind}, n long, rare array<struct<word:string,times:int>>"), "looked")
    rare = looked.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times")
    # the words are as many as the data has, so they are not to be sent to all tasks by way of the driver
    joined = rare.join(sized.select("word", F.col("n").alias("each")).hint("merge"), "word")
    parts = looked.select("key", "n").unionByName(joined.select("key", (F.col("times") * F.col("each")).cast("long").alias("n")))
    counts = parts.groupBy(F.col("key").alias(key)).agg(F.sum("n").cast("int").alias("n"))
    rows = df.select(key, F.col(text).isNotNull().alias("is_text"))
    return rows.join(counts, key, "left").select(key, F.when(F.col("is_text"), F.coalesce("n", F.lit(0))).alias("n_tokens"))


def subword_counter(ranks: Ranks) -> Callable[[list[str]], list[int]]:
    """A counter for ``count_tokens=`` of the chunker; it remembers the words of one call."""

    def count(texts: list[str]) -> list[int]:
        import regex

        divide, known = regex.compile(DIVISION), {}

        def size(word: str) -> int:
            if word not in known:
                known[word] = len(merged(word.encode(), ranks))
            return known[word]

        return [sum(map(size, divide.findall(t))) for t in texts]

    return count
