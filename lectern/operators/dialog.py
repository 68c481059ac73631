"""Dialogs to questions, histories, search queries and prompts.

Two inputs: the flat table ``(conv_id, turn, role, text)``, and rows that
already hold ``messages array<struct<role, content>>``. On the flat table
questions and vectors are aggregates that combine before the shuffle, and history
is an anti-join on the unique ``(conv_id, turn)``. Search queries and prompts are
one text per dialog, so there a task holds a whole dialog, and nothing larger.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import SUBJECT, literal_message, render
from ..functions.vectors import bucket_counts, unit
from .embedding import DIM
from .search import lookup


def extract_question(turns: DataFrame, last_user: bool = False) -> DataFrame:
    """The last message per dialog, whoever wrote it; optionally the last one of the user."""
    rows = turns.where(F.col("role") == "user") if last_user else turns
    last = F.max_by(F.struct("turn", "role", F.col("text").alias("question")), "turn").alias("last")
    return rows.groupBy("conv_id").agg(last).select("conv_id", "last.*")


def extract_history(turns: DataFrame, last_user: bool = False) -> DataFrame:
    """All messages before the question, as rows."""
    rows = turns.where(F.col("role") == "user") if last_user else turns
    at = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    if not last_user:
        return turns.join(at, ["conv_id", "turn"], "left_anti").select(*turns.columns)
    # messages after the user's last one belong to neither
    before = lookup(turns, at.withColumnRenamed("turn", "_at"), ["conv_id"], "turn")
    return before.where(F.col("turn") < F.col("_at")).select(*turns.columns)


def search_query(turns: DataFrame, last_user: bool = False) -> DataFrame:
    """``(conv_id, search_query)``: earlier user messages, then the question, joined by one space.

    Without history this is the question itself. A row per dialog, however
    long; a dialog is the largest thing that a task holds.
    """
    rows = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    if not last_user:
        # a last message of the user is among these already
        asked = extract_question(turns).where(~F.col("role").eqNullSafe("user"))
        rows = rows.unionByName(asked.select("conv_id", "turn", F.col("question").alias("text")))
    listed = F.sort_array(F.collect_list(F.struct("turn", "text")))
    text = F.array_join(F.transform(listed, lambda x: x["text"]), " ")
    return rows.groupBy("conv_id").agg(text.alias("search_query"))


def dialog_state(turns: DataFrame, dim: int = DIM) -> DataFrame:
    """``(conv_id, n_turns, question, role, embedding)`` in one aggregation.

    ``embedding`` is the vector of the search query. Word counts add up over
    messages, so the query's text is never assembled.
    """
    said = F.when(F.col("role") == "user", bucket_counts(F.col("text"), dim))
    counts = F.coalesce(said, F.array_repeat(F.lit(0), dim)).cast("array<double>")
    state = (
        turns.select("conv_id", "turn", "role", "text", array_to_vector(counts).alias("_counts"))
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.max_by(F.struct("role", F.col("text").alias("question")), "turn").alias("_last"),
            vector_to_array(Summarizer.sum(F.col("_counts"))).alias("_total"),
        )
        # the sum is kept as a running mean, so it is whole up to rounding
        .withColumn("_sums", F.transform("_total", lambda x: F.round(x).cast("int")))
    )
    # the question counts even when it is not a user message
    added = F.when(F.col("_last.role") == "user", F.col("_sums")).otherwise(
        F.zip_with("_sums", bucket_counts(F.col("_last.question"), dim), lambda a, b: a + b)
    )
    return state.select(
        "conv_id", "n_turns", "_last.question", "_last.role", unit(added).alias("embedding")
    )


def prompts(
    turns: DataFrame,
    template: str,
    subject: str = SUBJECT,
    extra: DataFrame | None = None,
) -> DataFrame:
    """``(conv_id, prompt)``: a template filled per dialog, one row whatever its length.

    ``extra`` may add one row of further slot columns per dialog, such as
    ``context``; dialogs it lacks get no prompt. The history is aggregated
    alone; what stands around it is joined to the finished rows.
    """
    dialogs = turns.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question"),
        F.max("turn").alias("last"),
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"),
    )
    earlier = F.filter("messages", lambda m: m["turn"] < F.col("last"))
    said = F.array_join(F.transform(earlier, lambda m: literal_message(m["role"], m["text"])), ", ")
    slots = {"subject": subject, "question": F.col("question"), "chat_history": F.concat(F.lit("["), said, F.lit("]"))}
    if extra is not None:
        dialogs = dialogs.join(extra, "conv_id")
        slots |= {c: F.col(c) for c in extra.columns if c != "conv_id"}
    return dialogs.select("conv_id", render(template, **slots).alias("prompt"))


def question_of(messages: Column) -> Column:
    """The last message's text."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def history_of(messages: Column) -> Column:
    """All messages before the last one."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def search_text_of(messages: Column) -> Column:
    """Earlier user messages, then the question, joined by one space."""
    said = F.transform(F.filter(history_of(messages), lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.array_join(F.concat(said, F.array(question_of(messages))), " ")


def history_text_of(messages: Column) -> Column:
    """The history as it stands in a prompt: a printed list of messages."""
    said = F.transform(history_of(messages), lambda m: literal_message(m["role"], m["content"]))
    return F.concat(F.lit("["), F.array_join(said, ", "), F.lit("]"))
