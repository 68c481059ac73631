"""Vector expressions: hashed word counts, unit length, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .text import words


def bucket(word: Column, dim: int) -> Column:
    """Bucket of a word: the first 32 bits of its MD5 modulo ``dim``."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def bucket_counts(text: Column, dim: int) -> Column:
    """Word counts per bucket as a dense ``array<int>``, linear in the text.

    Each bucket 0..dim is added once before sorting, so every bucket has a run
    and the count is the distance between neighbouring run starts, minus one.
    """
    hashed = F.transform(words(text), lambda w: bucket(w, dim))
    marked = F.sort_array(F.concat(hashed, F.sequence(F.lit(0), F.lit(dim))))

    def run_starts(s: Column) -> Column:
        marks = F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i))
        return F.array_compact(marks)

    def widths(at: Column) -> Column:
        return F.transform(
            F.slice(at, F.lit(1), F.lit(dim)), lambda x, i: (F.get(at, i + 1) - x - 1).cast("int")
        )

    return F.when(text.isNotNull(), let(let(marked, run_starts), widths))


def length_of(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(counts: Column) -> Column:
    """Unit-length ``array<float>``; NULL for a zero vector."""
    return let(
        counts,
        lambda v: let(
            length_of(v),
            lambda n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length_of(a) * length_of(b))
