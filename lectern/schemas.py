"""Explicit table schemas and the check made at stage boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

RAW_DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField("chunk_ix", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
    ]
)

INDEX = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

QUESTIONS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField("result", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
    ]
)

INPUTS = {
    "pages": PAGES,
    "documents": RAW_DOCUMENTS,
    "embeddings": VECTORS,
    "conversations": TURNS,
    "benchmark": QUESTIONS,
    "labels": LABELS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema`` by name; a missing or mistyped column is an error, not a silent NULL."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{f.name}: wanted {f.dataType.simpleString()}, found {have.get(f.name, 'nothing')}"
        for f in schema.fields
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise TypeError("schema mismatch: " + "; ".join(wrong))
    return df.select(*[f.name for f in schema.fields])
