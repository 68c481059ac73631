"""Documents to token-bounded chunks, as array expressions inside one narrow stage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import BLANKS, TOKEN, n_tokens, paragraphs, strip_ws, tokens
from ..schemas import CHUNKS, conform

#: Texts to their numbers of tokens.
Counter = Callable[[list[str]], list[int]]

# Fixed values.
MAX_TOKENS = 500
OVERLAP = 50
MIN_TOKENS = 20
#: Bytes of texts that a user's counter is given together, so that a task does not hold the words of a whole batch.
SLICE = 1 << 20


def merge_starts(counts: Column, limit: int) -> Column:
    """1-based positions where a merged block starts.

    A fold over the integer counts: a paragraph joins the open block while the
    total stays within ``limit``. Only block starts are stored, so the state
    grows with the blocks and holds no text.
    """

    def step(s: Column, x: Column) -> Column:
        fits = (s["i"] > 0) & (s["total"] + x <= limit)
        at = s["i"] + 1
        return F.struct(
            F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(at))).alias("starts"),
            F.when(fits, s["total"] + x).otherwise(x).alias("total"),
            at.alias("i"),
        )

    zero = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("total"), F.lit(0).alias("i")
    )
    return F.aggregate(counts, zero, step, lambda s: s["starts"])


def merge_paragraphs(ps: Column, limit: int) -> Column:
    """``array<struct<text, n>>``: neighbouring paragraphs merged up to ``limit`` tokens."""

    def block(ps_: Column, ns: Column, starts: Column) -> Column:
        def one(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(ps_) + 1)
            total = F.aggregate(F.slice(ns, start, end - start), F.lit(0), lambda a, x: a + x)
            text = strip_ws(F.array_join(F.slice(ps_, start, end - start), "\n"))
            return F.struct(text.alias("text"), total.alias("n"))

        return F.transform(starts, one)

    return let(
        ps,
        lambda p: let(
            F.transform(p, n_tokens),
            lambda ns: let(merge_starts(ns, limit), lambda starts: block(p, ns, starts)),
        ),
    )


def split_oversize(text: Column, n: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """``array<struct<text, n>>``: token windows of ``size`` that share ``overlap`` tokens.

    Text within ``size`` stays as it is, line breaks included.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")

    def window(ts: Column, i: Column) -> Column:
        part = F.slice(ts, i * step + 1, F.lit(size))
        return F.struct(F.array_join(part, " ").alias("text"), F.size(part).alias("n"))

    return F.when(n <= size, F.array(F.struct(text.alias("text"), n.alias("n")))).otherwise(
        let(tokens(text), lambda ts: F.transform(F.sequence(F.lit(0), last), lambda i: window(ts, i)))
    )


def chunk_texts(
    content: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS
) -> Column:
    """All chunks of a text, ``array<struct<text, n>>``; small ones are dropped."""
    blocks = merge_paragraphs(paragraphs(content), max_tokens // 2)
    pieces = F.flatten(F.transform(blocks, lambda b: split_oversize(b["text"], b["n"], max_tokens, overlap)))
    return F.filter(pieces, lambda p: p["n"] > min_tokens)


def drop_small(df: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return df.where(F.col("n_tokens") > min_tokens)


def chunk_rows(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per array element; a NULL or empty array gives none.

    The outer form plus a filter on the result: the plain form makes Spark test
    the array's size first, which computes a derived array again.
    """
    rest = [c for c in df.columns if c != chunks]
    rows = df.select(*rest, F.posexplode_outer(chunks).alias("chunk_ix", "chunk"))
    return rows.where(F.col("chunk_ix").isNotNull())


def chunk_key(url: Column, chunk_ix: Column) -> Column:
    """Unique chunk key: one URL has many chunks."""
    return F.md5(F.concat(url, F.lit("#"), chunk_ix.cast("string")))


def with_chunk_id(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", chunk_key(F.col("url"), F.col("chunk_ix")))


def one_per_url(documents: DataFrame, order: Column | None = None) -> DataFrame:
    """One document per URL, as chunk keys need it: the last by ``order``, ties by content digest and title.

    Rows of one URL combine before the shuffle, so a URL that very many rows
    share costs one row per task.
    """
    rank = F.struct(F.lit(0) if order is None else order, F.md5("content"), "page_title")
    kept = documents.groupBy("url").agg(F.max_by(F.struct("page_title", "content"), rank).alias("kept"))
    return kept.select("url", "kept.page_title", "kept.content")


def repeated_urls(documents: DataFrame) -> DataFrame:
    """URLs of several rows, with their number: what ``one_per_url`` leaves out of each but one."""
    return documents.groupBy("url").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def chunk_documents(
    documents: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    min_tokens: int = MIN_TOKENS,
    count_tokens: Counter | None = None,
) -> DataFrame:
    """Documents to chunk rows, key included. Documents without content give none.

    ``count_tokens`` replaces the counting of non-blank runs by a tokenizer's:
    it gets a list of texts and returns their numbers of tokens.
    """
    if count_tokens is None:
        listed = chunk_texts(F.col("content"), max_tokens, overlap, min_tokens)
    else:
        chunker = _chunker(max_tokens, overlap, min_tokens, count_tokens)

        @F.arrow_udf("array<struct<text:string,n:int>>")
        def counted(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("text", pa.string()), ("n", pa.int32())]))
            return pa.concat_arrays([pa.array([[{"text": t, "n": n} for t, n in row] for row in some], kind) for some in _sliced(texts, chunker)])

        listed = counted(F.col("content"))
    rows = with_chunk_id(chunk_rows(documents.select("url", "page_title", listed.alias("chunks"))))
    return conform(rows.withColumn("text", F.col("chunk.text")).withColumn("n_tokens", F.col("chunk.n")), CHUNKS)


def with_text_alias(chunks: DataFrame, name: str = "text2") -> DataFrame:
    """All columns plus the chunk text under a second name."""
    return chunks.select("*", F.col("text").alias(name))


def _count_runs(texts: list[str]) -> list[int]:
    return [len(re.findall(TOKEN, t, re.ASCII)) for t in texts]


def _windows(words: list[str], costs: list[int], size: int, overlap: int) -> list[tuple[str, int]]:
    """Windows of words within ``size`` tokens, one word at least; the next goes back by up to ``overlap`` tokens."""
    found, start = [], 0
    while True:
        end, total = start + 1, costs[start]
        while end < len(words) and total + costs[end] <= size:
            total += costs[end]
            end += 1
        found.append((" ".join(words[start:end]), total))
        if end == len(words):
            return found
        back, shared = end, 0
        while back > start + 1 and shared + costs[back - 1] <= overlap:
            back -= 1
            shared += costs[back]
        start = back


def _chunker(max_tokens: int, overlap: int, min_tokens: int, count_tokens: Counter) -> Callable:
    """Texts to their chunks with token counts; the counter is called twice per list of texts, for lines and for words."""

    def chunk(texts: list[str | None]) -> list[list[tuple[str, int]]]:
        lines = [[p for p in (t or "").split("\n") if p.strip(BLANKS)] for t in texts]
        counts = iter(count_tokens([p for ps in lines for p in ps]))
        merged = []
        for ps in lines:
            blocks: list[tuple[str, int]] = []
            for line in ps:
                n = next(counts)
                if blocks and blocks[-1][1] + n <= max_tokens // 2:
                    blocks[-1] = (blocks[-1][0] + "\n" + line, blocks[-1][1] + n)
                else:
                    blocks.append((line, n))
            merged.append([(body, n, re.findall(TOKEN, body, re.ASCII) if n > max_tokens else []) for body, n in blocks])
        costs = iter(count_tokens([w for blocks in merged for _, _, words in blocks for w in words]))
        found = []
        for blocks in merged:
            pieces: list[tuple[str, int]] = []
            for body, n, words in blocks:
                cut = _windows(words, [next(costs) for _ in words], max_tokens, overlap) if words else [(body.strip(BLANKS), n)]
                pieces += cut
            found.append([(t, n) for t, n in pieces if n > min_tokens])
        return found

    return chunk


def _sliced(texts: pa.Array, chunker: Callable) -> Iterator[list[list[tuple[str, int]]]]:
    """What the chunker makes of a batch, about ``SLICE`` bytes of texts at a time and one list at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().cumsum()
    begin = 0
    while begin < len(texts) or not begin:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(sizes.searchsorted(before + SLICE, "right")))
        yield chunker(texts.slice(begin, end - begin).to_pylist())
        begin = end


def chunk_udf(
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    min_tokens: int = MIN_TOKENS,
    count_tokens: Counter = _count_runs,
):
    """The chunker as a vectorised function ``string -> array<string>``, with a tokenizer of the user's own.

    Without one it agrees with the expressions above, which stay the default.
    """
    chunker = _chunker(max_tokens, overlap, min_tokens, count_tokens)

    @F.arrow_udf("array<string>")
    def chunk_batch(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return pa.concat_arrays([pa.array([[t for t, _ in row] for row in some], kind) for some in _sliced(texts, chunker)])

    return chunk_batch
