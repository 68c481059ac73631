"""Dialogs to answers in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import SUBJECT, render
from ..operators.answers import (
    THRESHOLD,
    answer_extractive,
    format_context,
    refuse,
    route,
    source_urls,
    topic_centroid,
    topic_gate,
)
from ..operators.dialog import dialog_state, history_of, history_text_of, question_of, search_text_of
from ..operators.embedding import DIM, embed, embed_text, model_name
from ..operators.index import require_same_model
from ..operators.models import model_stage
from ..operators.search import RETRIEVED, gather, topk_vector, with_item_columns
from ..session import materialise

DOC_COLUMNS = ["url", "page_title", "text"]


def _with_docs(asked: DataFrame, index: DataFrame, k: int, key: str) -> DataFrame:
    hits = topk_vector(asked, index, k, qid=key)
    docs = gather(with_item_columns(hits, index, DOC_COLUMNS, qid=key), key)
    return asked.join(docs, key, "left")


def judged_dialogs(
    turns: DataFrame,
    index: DataFrame,
    threshold: float = THRESHOLD,
    dim: int = DIM,
    centroid: DataFrame | None = None,
) -> DataFrame:
    """One row per dialog: question, search vector and topic verdict.

    A stored ``centroid`` saves the pass over the index that computes it.
    """
    state = dialog_state(turns, dim).withColumn("_asked", embed_text(F.col("question"), dim))
    center = topic_centroid(index) if centroid is None else centroid
    return topic_gate(state, center, threshold, "_asked").drop("_asked")


def retrieved_dialogs(judged: DataFrame, index: DataFrame, k: int = RETRIEVED) -> DataFrame:
    """The relevant dialogs with their retrieved texts."""
    return _with_docs(route(judged)[0], index, k, "conv_id")


def answer_all(
    turns: DataFrame,
    index: DataFrame,
    k: int = RETRIEVED,
    threshold: float = THRESHOLD,
    dim: int = DIM,
    centroid: DataFrame | None = None,
) -> DataFrame:
    """``(conv_id, result, sources)`` for every dialog of the flat table.

    The judged dialogs are written once, as both branches and the search read
    them. Refused dialogs take no part in the search.
    """
    judged = materialise(
        judged_dialogs(turns, index, threshold, dim, centroid).withColumn("model", F.lit(model_name(dim))),
        "dialogs",
    )
    require_same_model(index, judged.where(F.col("embedding").isNotNull()))
    found = retrieved_dialogs(judged, index, k)
    answered = found.select(
        "conv_id",
        answer_extractive(F.col("question"), F.col("docs")).alias("result"),
        F.coalesce(source_urls(F.col("docs")), F.array().cast("array<string>")).alias("sources"),
    )
    return answered.unionByName(refuse(route(judged)[1]))


def answer_dialogs(
    dialogs: DataFrame,
    index: DataFrame,
    models: dict[str, Callable[[list[str]], list[str]]],
    key: str = "conv_id",
    k: int = RETRIEVED,
    subject: str = SUBJECT,
    always_rewrite: bool = False,
    templates: dict[str, str] | None = None,
    dim: int = DIM,
    encoder=None,
    model: str | None = None,
) -> DataFrame:
    """``(key, result, sources)`` for rows with ``messages``, by the user's own models.

    ``models`` holds callables for ``gate``, ``rewrite`` and ``answer``. Model
    outputs are written once so that no later step calls a model again.
    """
    named = {"gate": "gate", "rewrite": "rewrite_knn", "answer": "answer"} | (templates or {})
    said = history_text_of(F.col("messages"))
    asked = question_of(F.col("messages"))

    def prompt(name: str, **more) -> F.Column:
        return render(named[name], chat_history=said, question=asked, subject=subject, **more)

    gated = model_stage(
        dialogs.withColumn("_prompt", prompt("gate")), models["gate"], "_prompt", "question_is_relevant"
    )
    judged = materialise(gated.drop("_prompt"), "verdicts")
    relevant, refused = route(judged)

    alone = F.size(history_of(F.col("messages"))) == 0
    if "rewrite" in models:
        to_write = relevant if always_rewrite else relevant.where(~alone)
        written = model_stage(
            to_write.withColumn("_prompt", prompt("rewrite")), models["rewrite"], "_prompt", "search_query"
        ).drop("_prompt")
        if not always_rewrite:
            written = written.unionByName(relevant.where(alone).withColumn("search_query", asked))
    else:
        written = relevant.withColumn("search_query", search_text_of(F.col("messages")))
    written = materialise(written, "queries")

    vectors = embed(written.select(key, "search_query"), "search_query", dim, encoder, model)
    vectors = materialise(vectors.select(key, "model", "embedding"), "query-vectors")
    require_same_model(index, vectors)
    hits = topk_vector(vectors, index, k, qid=key)
    docs = gather(with_item_columns(hits, index, DOC_COLUMNS, qid=key), key)
    found = written.join(docs, key, "left")
    ready = found.select(
        key,
        prompt("answer", context=format_context(F.col("docs"))).alias("_prompt"),
        F.coalesce(source_urls(F.col("docs")), F.array().cast("array<string>")).alias("sources"),
    )
    answered = model_stage(ready, models["answer"], "_prompt", "result").select(key, "result", "sources")
    return answered.unionByName(refuse(refused, key))
