"""Text to vectors, with the name of the model that made them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..functions.vectors import bucket_counts, unit
from .models import model_stage

DIM = 64


def model_name(dim: int = DIM) -> str:
    return f"hashed-words-{dim}"


def embed_text(text: Column, dim: int = DIM) -> Column:
    """Unit vector of hashed word counts; NULL when the text has no words."""
    return unit(bucket_counts(text, dim))


def embed(
    df: DataFrame,
    text: str,
    dim: int = DIM,
    encoder: Callable[[list[str]], Iterable[list[float]]] | None = None,
    model: str | None = None,
) -> DataFrame:
    """Add ``model`` and ``embedding``; rows without a vector are left out.

    Documents and questions go through this one function, so both carry the
    same model name. ``encoder`` replaces the lexical default by a real model.
    """
    if encoder is None:
        # the same rows as "embedding is not null", without computing the vector twice
        with_words = df.where(F.lower(text).rlike(WORD))
        return with_words.withColumn("model", F.lit(model or model_name(dim))).withColumn(
            "embedding", embed_text(F.col(text), dim)
        )
    if model is None:
        raise ValueError("name the model of the encoder")
    made = model_stage(df, encoder, text, "embedding", "array<float>").withColumn("model", F.lit(model))
    return made.select(*df.columns, "model", "embedding").where(F.col("embedding").isNotNull())


def sparse_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The non-zero entries of each vector as rows ``(key, bucket, value)``."""
    # the outer form: the plain one would test, and so compute, the vector once more
    return df.select(key, F.posexplode_outer(vector).alias("bucket", "value")).where(F.col("value") != 0)
