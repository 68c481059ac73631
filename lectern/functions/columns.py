"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Lambdas are not covered by common-subexpression elimination, so a costly
    expression named inside one would run once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(values: Column) -> Column:
    """Totals up to each element of an ``array<int>``.

    A fold that appends copies what it has at each step. So totals are made for
    blocks of about the square root of the length, and within each block.
    """

    def totals(block: Column, start: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("sums"), start.alias("total"))

        def step(s: Column, x: Column) -> Column:
            total = s["total"] + x
            return F.struct(F.concat(s["sums"], F.array(total)).alias("sums"), total.alias("total"))

        return F.aggregate(block, zero, step, lambda s: s["sums"])

    def of_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(
            totals(whole, F.lit(0)),
            lambda ends: F.flatten(F.transform(blocks, lambda b, i: totals(b, F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))),
        )

    def cut(v: Column, width: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))

    width = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
    return let(values, lambda v: let(width(v), lambda w: let(cut(v, w), of_blocks)))
