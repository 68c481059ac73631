"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, renamed; other columns of any name cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``by``: the same rows in every run."""
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows of ``df``, picked by a hash of ``by`` alone: a filter, the same rows in every run."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30)))
