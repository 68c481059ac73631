"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, decontaminate, jaccard, langid, licenses, mixing, negatives, packing, ppm, quality, runs, secrets, sharding
from .common import held_out
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the labels outside the held-out fold."""
    documents = _table(spark, folder, "documents")
    out = held_out("doc_id", 3, 1)
    model = langid.fit(documents.where(~out))
    found = langid.identify(documents, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document: template, covered share, span."""
    return licenses.scan(_table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    mixed = mixing.taken(mixing.mix(_table(spark, folder, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 24 shards of nearly equal bytes."""
    placed = sharding.shard(_table(spark, folder, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    documents, out = _table(spark, folder, "documents"), held_out("doc_id", 4, 2)
    forest = quality.fit(documents, _table(spark, folder, "labels").where(~out))
    found = quality.rate(documents, forest)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learnt from all outside the held-out fold."""
    documents, out = _table(spark, folder, "documents"), held_out("doc_id", 5, 1)
    found = ppm.score(documents, documents.where(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set and its component of near copies."""
    return jaccard.join(_table(spark, folder, "documents")).withColumnRenamed("component", "component_id")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: known forms, and what is as random as a key."""
    found = secrets.scan(_table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in documents, also with other numbers, names and units; a row per document and item."""
    found = decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), bare=True)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.min("exchanged").alias("exchanged")
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and whether the cascade of rules keeps it."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = cascade.screen(_table(spark, folder, "documents"), wanted=counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def _stretched(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that are searched: of every tenth document, by its crc32, the end repeats itself."""
    known = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), known // 10
    if known % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, its strongest run, and digests of all runs and of the text without repeats."""
    found = runs.scan(_table(spark, folder, "documents"), change=_stretched)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where every piece of every document's tokens stands in sequences of 1024."""
    import public_tokenizers

    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its positives."""
    given = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(given.select("vec_id", "embedding", label.alias("label")), anchor="id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_lm_scores": op6_lm_scores,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}
