"""Gate, routing, context, sources and answers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import paragraphs, words
from ..functions.vectors import cosine

# Fixed values.
REFUSAL = "I cannot answer questions that are not about U.S. Citizenship and Immigation policies."
NO_TITLE = "None"

THRESHOLD = 0.5


def topic_centroid(index: DataFrame) -> DataFrame:
    """Mean vector of the index: one row, averaged in each task before the shuffle."""
    vectors = array_to_vector(F.col("embedding").cast("array<double>"))
    return index.agg(vector_to_array(Summarizer.mean(vectors)).alias("centroid"))


def topic_gate(
    questions: DataFrame,
    centroid: DataFrame,
    threshold: float = THRESHOLD,
    vector: str = "embedding",
    inappropriate: str | None = None,
) -> DataFrame:
    """Add ``topic_score`` and ``question_is_relevant``.

    "yes" from the threshold upwards unless the question is marked
    inappropriate; a missing mark means it is not. No vector, no verdict.
    """
    # a one-row subquery, not a join; it needs a column of its own outside the lambdas
    questions = questions.withColumn("_centroid", centroid.scalar())
    score = F.round(cosine(F.col(vector), F.col("_centroid")), 4)
    marked = F.lit(False) if inappropriate is None else F.coalesce(F.col(inappropriate), F.lit(False))
    near = F.col("topic_score") >= threshold
    verdict = F.when(near & ~marked, "yes").when(near.isNotNull(), "no")
    scored = questions.withColumn("topic_score", score).drop("_centroid")
    return scored.withColumn("question_is_relevant", verdict)


def is_relevant(verdict: Column) -> Column:
    """A verdict that holds "yes"; everything else refuses, a missing verdict too."""
    return F.coalesce(F.contains(F.lower(verdict), F.lit("yes")), F.lit(False))


def route(df: DataFrame, verdict: str = "question_is_relevant") -> tuple[DataFrame, DataFrame]:
    """Rows to answer and rows to refuse, split before any retrieval."""
    yes = is_relevant(F.col(verdict))
    return df.where(yes), df.where(~yes)


def refuse(df: DataFrame, key: str = "conv_id", text: str = REFUSAL) -> DataFrame:
    """The fixed refusal without sources."""
    return df.select(
        key, F.lit(text).alias("result"), F.array().cast("array<string>").alias("sources")
    )


def format_context(docs: Column) -> Column:
    """Retrieved texts in rank order with a blank line between."""
    return F.array_join(F.transform(docs, lambda d: d["text"]), "\n\n")


def source_urls(docs: Column) -> Column:
    """``url page:title`` per retrieved text."""
    return F.transform(
        docs, lambda d: F.concat(d["url"], F.lit(" page:"), F.coalesce(d["page_title"], F.lit(NO_TITLE)))
    )


def answer_extractive(question: Column, docs: Column) -> Column:
    """The retrieved paragraph that shares most words with the question.

    Ties go to the better rank, then the earlier paragraph, so without any
    shared word it is the top text's first paragraph.
    """

    def scored(asked: Column, doc: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            return F.struct(
                F.size(F.array_intersect(asked, words(p))).alias("shared"),
                (-doc["rk"]).alias("rank"),
                (-i).alias("place"),
                p.alias("text"),
            )

        return F.transform(paragraphs(doc["text"]), one)

    return let(
        F.array_distinct(words(question)),
        lambda asked: F.array_max(F.flatten(F.transform(docs, lambda d: scored(asked, d))))["text"],
    )


def answer_struct(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``answer struct<result, sources>``."""
    return df.select(key, F.struct("result", "sources").alias("answer"))
