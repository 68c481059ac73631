"""Text to chunks by a list of separators, coarse ones first, with overlap.

A text above the budget is cut behind each occurrence of the first separator;
what is still above it, behind each occurrence of the second; and so on. So a
part is as long as the coarsest separators allow, and nothing is lost: the
parts joined are the text. Parts are then gathered in order while they fit.
A chunk begins with as many whole parts of the end of the chunk before as the
overlap allows.

All of it is array expressions in one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import n_tokens, strip_ws
from ..schemas import CHUNKS, conform
from .chunks import MAX_TOKENS, MIN_TOKENS, OVERLAP, chunk_rows, with_chunk_id

#: Paragraphs, lines, sentences, words.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _cut(text: Column, separator: str) -> Column:
    """The text cut behind each occurrence of a separator, from the left."""
    pattern = "".join(f"\\x{{{ord(c):x}}}" for c in separator)

    def closed(parts: Column) -> Column:
        whole = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(separator))).otherwise(p))
        return F.filter(whole, lambda p: p != "")

    return let(F.split(text, pattern), closed)


def parts_of(text: Column, max_tokens: int = MAX_TOKENS, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """``array<struct<text, n>>``: parts within ``max_tokens`` where some separator allows it."""

    def sized(text: Column) -> Column:
        return F.struct(text.alias("text"), n_tokens(text).alias("n"))

    def divided(parts: Column, separator: str) -> Column:
        return F.flatten(
            F.transform(
                parts,
                lambda p: F.when(p["n"] <= max_tokens, F.array(p)).otherwise(F.transform(_cut(p["text"], separator), lambda t: sized(t))),
            )
        )

    parts = F.when(text != "", F.array(sized(text))).when(text == "", F.array().cast("array<struct<text:string,n:int>>"))
    for separator in separators:
        parts = divided(parts, separator)
    return parts


def spans(counts: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """``array<struct<first, last>>``, 1-based: which parts make a chunk.

    A fold over the counts with the running totals at hand. A part joins the
    open chunk while that stays within ``max_tokens``, and always joins one
    without tokens; else the next chunk goes back as far as ``overlap`` and the
    new part allow. A part above ``max_tokens`` is a chunk of its own.
    """
    kind = "array<struct<first:int,last:int>>"

    def totals(c: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("sums"), F.lit(0).alias("total"))
        return F.aggregate(
            c,
            start,
            lambda s, x: F.struct(F.concat(s["sums"], F.array(s["total"] + x)).alias("sums"), (s["total"] + x).alias("total")),
            lambda s: s["sums"],
        )

    def walk(c: Column, sums: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            done = s["i"]  # parts before this one
            before = F.get(sums, done)
            held = before - F.get(sums, s["first"] - 1)
            fits = (held == 0) | (held + x <= max_tokens)
            room = F.greatest(F.least(F.lit(overlap), max_tokens - x), F.lit(0))
            # the first part from which on the end of the chunk is within the room; totals never fall
            back = F.size(F.filter(sums, lambda t: t < before - room)) + 1
            return F.struct(
                F.when(fits, s["made"]).otherwise(F.concat(s["made"], F.array(F.struct(s["first"].alias("first"), done.alias("last"))))).alias("made"),
                F.when(fits, s["first"]).otherwise(F.greatest(back, s["first"] + 1)).cast("int").alias("first"),
                (done + 1).alias("i"),
            )

        zero = F.struct(F.array().cast(kind).alias("made"), F.lit(1).alias("first"), F.lit(0).alias("i"))
        return F.aggregate(
            c,
            zero,
            step,
            lambda s: F.when(s["i"] > 0, F.concat(s["made"], F.array(F.struct(s["first"].alias("first"), s["i"].alias("last"))))).otherwise(s["made"]),
        )

    return let(counts, lambda c: let(totals(c), lambda sums: walk(c, sums)))


def split_recursively(
    text: Column,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> Column:
    """``array<struct<text, n>>``: chunks of a text, stripped; a text without tokens has none, NULL gives NULL."""

    def chunk(parts: Column, span: Column) -> Column:
        held = F.slice(parts, span["first"], span["last"] - span["first"] + 1)
        body = strip_ws(F.array_join(F.transform(held, lambda p: p["text"]), ""))
        return F.struct(body.alias("text"), F.aggregate(held, F.lit(0), lambda a, p: a + p["n"]).alias("n"))

    return let(
        parts_of(text, max_tokens, separators),
        lambda parts: F.filter(
            F.transform(spans(F.transform(parts, lambda p: p["n"]), max_tokens, overlap), lambda s: chunk(parts, s)), lambda c: c["n"] > 0
        ),
    )


def chunk_recursively(
    documents: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    min_tokens: int = MIN_TOKENS,
    separators: tuple[str, ...] = SEPARATORS,
) -> DataFrame:
    """Documents to chunk rows, key included, as ``chunk_documents`` gives them; chunks up to ``min_tokens`` are dropped."""
    listed = F.filter(split_recursively(F.col("content"), max_tokens, overlap, separators), lambda c: c["n"] > min_tokens)
    rows = with_chunk_id(chunk_rows(documents.select("url", "page_title", listed.alias("chunks"))))
    return conform(rows.withColumn("text", F.col("chunk.text")).withColumn("n_tokens", F.col("chunk.n")), CHUNKS)
