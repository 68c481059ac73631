"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import ANY_TAG
from ..functions.text import TOKEN, collapse_newlines, n_tokens, paragraphs, strip_ws
from ..operators import (
    answers, bounded, chunks, dialog, digests, embedding, index, ivf, lexical, models, pages, search, seen, splitting, store, subwords,
)
from ..schemas import DOCUMENTS, INDEX, INPUTS, RAW_DOCUMENTS
from ..session import materialise, work_path
from ..sources import archive, tables
from ..streaming import state, sync
from . import answering, ingest

# The given pages have no class or id to select by.
LINKS, TITLE, CONTENT = "nav", "h1", "article"
GATE = 0.7
#: A public vocabulary, where it is installed.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{folder}/{name}.parquet", INPUTS[name])


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return tables.page_source(tables.spread(_table(spark, folder, "pages")))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents_from_table(tables.spread(_table(spark, folder, "documents")))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunk_documents(_documents(spark, folder))


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(index.build_index(_chunks(spark, folder)), "index")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return tables.spread(_table(spark, folder, "conversations"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels, where there are any."""
    documents = tables.spread(_table(spark, folder, "documents"))
    return documents.join(_table(spark, folder, "labels"), "doc_id", "left")


def _withdrawn(spark: SparkSession, folder: str) -> DataFrame:
    """Document table in which toxic documents have lost their content."""
    return _labelled(spark, folder).select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("source").alias("page_title"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, F.col("text")).alias("content"),
    )


def _reviewed_then(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier document table: the labelled documents."""
    rows = _labelled(spark, folder).where(F.col("quality").isNotNull())
    return rows.select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("source").alias("page_title"),
        F.col("text").alias("content"),
    )


def _reviewed_now(spark: SparkSession, folder: str) -> DataFrame:
    """Later document table: toxic documents gone, poor ones noted as such, the rest added."""
    rows = _labelled(spark, folder).where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    note = F.when(F.col("quality") == 0, "\nUnder review.").otherwise("")
    return rows.select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("source").alias("page_title"),
        F.concat("text", note).alias("content"),
    )


def _sparse(df: DataFrame, key: str) -> DataFrame:
    rows = embedding.sparse_vectors(df, key)
    return rows.select(key, "bucket", F.round(F.col("value").cast("double"), 6).alias("value"))


# ---- sources, sinks, table maintenance


@_query
def table_scan(spark, folder):
    return _table(spark, folder, "documents")


@_query
def page_source(spark, folder):
    return _pages(spark, folder)


@_query
def archived_pages(spark, folder):
    """Pages written as archive files, every fifth with another status, and read back."""
    path, status = work_path(spark, "archive"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    archive.write_archive(_table(spark, folder, "pages"), path, status)
    return archive.archived_pages(archive.read_archive(spark, path))


@_query
def documents_from_pages(spark, folder):
    return pages.documents_from_pages(_pages(spark, folder), TITLE, CONTENT)


@_query
def load_pages(spark, folder):
    return ingest.load_pages(
        spark, _table(spark, folder, "pages"), work_path(spark, "documents"), title=TITLE, content=CONTENT
    )


@_query
def overwrite_table(spark, folder):
    path = work_path(spark, "chunks")
    tables.write_table(chunks.chunk_documents(_reviewed_then(spark, folder)), path)
    tables.write_table(_chunks(spark, folder), path)
    return spark.read.parquet(path)


@_query
def create_table_as(spark, folder):
    name = f"chunks_{uuid.uuid4().hex}"
    return tables.create_table_as(
        name, chunks.with_text_alias(_chunks(spark, folder)), work_path(spark, name)
    )


@_query
def drop_null_content(spark, folder):
    return tables.drop_null_content(_withdrawn(spark, folder))


@_query
def content_counts(spark, folder):
    return pages.content_counts(_withdrawn(spark, folder))


@_query
def snapshot_diff(spark, folder):
    old, new = _reviewed_then(spark, folder), _reviewed_now(spark, folder)
    return index.snapshot_diff(old, new, "url", ["page_title", "content"])


@_query
def tree_diff(spark, folder):
    """The same between stored snapshots, by the leaves whose digests differ."""
    old, new = work_path(spark, "snapshot"), work_path(spark, "snapshot")
    for path, documents in ((old, _reviewed_then(spark, folder)), (new, _reviewed_now(spark, folder))):
        digests.write_snapshot(documents, path, "url", ["page_title", "content"])
    return digests.tree_diff(spark, old, new, "url", ["page_title", "content"]).changes


@_query
def tree_diff_cost(spark, folder):
    """How much of the tree and of the rows is read when one document in a hundred has changed."""
    old, new, documents = work_path(spark, "snapshot"), work_path(spark, "snapshot"), _documents(spark, folder)
    note = F.when(F.col("url").cast("long") % 100 == 0, "\nUnder review.").otherwise("")
    for path, rows in ((old, documents), (new, documents.withColumn("content", F.concat("content", note)))):
        digests.write_snapshot(rows, path, "url", ["page_title", "content"])
    found = digests.tree_diff(spark, old, new, "url", ["page_title", "content"])
    counts = [F.lit(found.n_leaves).alias("n_leaves"), F.lit(found.compared).alias("n_compared"), F.lit(len(found.leaves)).alias("n_read")]
    return found.changes.agg(F.count("*").alias("n_changed")).select(*counts, "n_changed")


# ---- page extraction


@_query
def page_links(spark, folder):
    return pages.extract_links(_pages(spark, folder), LINKS)


@_query
def resolve_url(spark, folder):
    return pages.resolve_links(pages.extract_links(_pages(spark, folder), LINKS))


@_query
def toc_urls(spark, folder):
    return pages.toc_urls(_pages(spark, folder), LINKS, "https://www.example.com/manual/")


@_query
def frontier_limit(spark, folder):
    return pages.frontier_limit(pages.toc_urls(_pages(spark, folder), LINKS))


@_query
def frontier_distinct(spark, folder):
    return pages.frontier_distinct(pages.toc_urls(_pages(spark, folder), LINKS))


@_query
def frontier_unseen(spark, folder):
    """Links of all pages to URLs that a crawl of every second page has not seen."""
    root, frontier = work_path(spark, "seen"), pages.toc_urls(_pages(spark, folder), LINKS)
    seen.note_seen(spark, root, frontier.where("page_id % 2 = 0"), 1)
    return seen.unseen(spark, root, frontier)


@_query
def page_title(spark, folder):
    return _pages(spark, folder).select("page_id", pages.extract_title(F.col("html"), TITLE).alias("page_title"))


@_query
def nested_elements(spark, folder):
    """Link texts by a selector of elements within each other."""
    return pages.element_texts(_pages(spark, folder), "nav li > a")


@_query
def page_content(spark, folder):
    content = pages.extract_content(F.col("html"), CONTENT)
    return _pages(spark, folder).select("page_id", content.alias("content"))


@_query
def collapse_newlines_of_pages(spark, folder):
    lines = F.regexp_replace("html", ANY_TAG, "\n")
    return _pages(spark, folder).select("page_id", collapse_newlines(lines).alias("lines"))


@_query
def strip_pages(spark, folder):
    lines = F.regexp_replace("html", ANY_TAG, "\n")
    return _pages(spark, folder).select("page_id", strip_ws(lines).alias("lines"))


# ---- chunking


@_query
def token_count(spark, folder):
    return _documents(spark, folder).select("url", n_tokens(F.col("content")).alias("n_tokens"))


@_query
def subword_count(spark, folder):
    """Tokens of a byte-pair vocabulary, each distinct word merged once."""
    return subwords.subword_counts(_documents(spark, folder), subwords.read_ranks(spark, VOCABULARY), "url", "content")


@_query
def paragraph_rows(spark, folder):
    return _documents(spark, folder).select(
        "url", F.posexplode(paragraphs(F.col("content"))).alias("pos", "paragraph")
    )


@_query
def merged_paragraphs(spark, folder):
    merged = chunks.merge_paragraphs(paragraphs(F.col("content")), chunks.MAX_TOKENS // 2)
    rows = _documents(spark, folder).select("url", F.posexplode(merged).alias("block", "b"))
    return rows.select("url", "block", F.col("b.text").alias("text"), F.col("b.n").alias("n_tokens"))


@_query
def oversize_windows(spark, folder):
    """Windows of whole documents, line breaks ignored."""
    windows = chunks.split_oversize(F.col("content"), n_tokens(F.col("content")))
    rows = _documents(spark, folder).select("url", F.posexplode(windows).alias("window", "w"))
    return rows.select("url", "window", F.col("w.text").alias("text"), F.col("w.n").alias("n_tokens"))


@_query
def drop_small_documents(spark, folder):
    counted = _documents(spark, folder).withColumn("n_tokens", n_tokens(F.col("content")))
    return chunks.drop_small(counted.select("url", "n_tokens"))


@_query
def chunk_rows(spark, folder):
    listed = _withdrawn(spark, folder).select("url", chunks.chunk_texts(F.col("content")).alias("chunks"))
    return chunks.chunk_rows(listed).select("url", "chunk_ix", F.col("chunk.text").alias("text"))


@_query
def text_alias(spark, folder):
    return chunks.with_text_alias(_chunks(spark, folder)).select("url", "page_title", "text2")


@_query
def chunk_documents(spark, folder):
    return _chunks(spark, folder)


@_query
def chunk_with_counter(spark, folder):
    """A user's token counter, here one that counts what the default counts."""

    def count(texts: list[str]) -> list[int]:
        return [len(re.findall(TOKEN, t, re.ASCII)) for t in texts]

    return chunks.chunk_documents(_documents(spark, folder), count_tokens=count)


@_query
def recursive_chunks(spark, folder):
    """Chunks by separators from paragraphs down to words, with overlap."""
    return splitting.chunk_recursively(_documents(spark, folder))


@_query
def recursive_parts(spark, folder):
    """What whole documents are cut into for a small budget."""
    parts = splitting.parts_of(F.col("content"), 40)
    rows = _documents(spark, folder).select("url", F.posexplode(parts).alias("pos", "p"))
    return rows.select("url", "pos", F.col("p.text").alias("text"), F.col("p.n").alias("n_tokens"))


@_query
def chunk_pages(spark, folder):
    documents = pages.documents_from_pages(_pages(spark, folder), TITLE, CONTENT)
    return chunks.chunk_documents(documents)


@_query
def chunk_key(spark, folder):
    return _chunks(spark, folder).select("chunk_id", "url", "chunk_ix")


@_query
def chunk_function(spark, folder):
    listed = _documents(spark, folder).select("url", chunks.chunk_udf()("content").alias("chunks"))
    return chunks.chunk_rows(listed).select("url", "chunk_ix", F.col("chunk").alias("text"))


# ---- embedding and index


@_query
def embed_documents(spark, folder):
    return _sparse(embedding.embed(_documents(spark, folder), "content"), "url")


@_query
def embed_questions(spark, folder):
    return _sparse(embedding.embed(_questions(spark, folder), "text"), "query_id")


@_query
def build_index(spark, folder):
    return index.build_index(_chunks(spark, folder)).select(
        "chunk_id", "url", "page_title", "text", "model", F.size("embedding").alias("dim")
    )


@_query
def index_vectors(spark, folder):
    """The vectors of a fresh index."""
    return _sparse(index.build_index(_chunks(spark, folder)), "chunk_id")


def _synced(spark, folder) -> DataFrame:
    """An index of the earlier documents, brought in step with the later ones."""
    root = work_path(spark, "index")
    ingest.index_documents(spark, _reviewed_then(spark, folder), root)
    return ingest.index_documents(spark, _reviewed_now(spark, folder), root)


@_query
def upsert_index(spark, folder):
    return _sparse(_synced(spark, folder), "chunk_id")


@_query
def sync_index(spark, folder):
    then = index.build_index(chunks.chunk_documents(_reviewed_then(spark, folder)))
    now = chunks.chunk_documents(_reviewed_now(spark, folder))
    rows = index.sync_index(materialise(then, "index"), materialise(now, "chunks"))
    return _sparse(rows, "chunk_id")


@_query
def sync_partitions(spark, folder):
    """The same in hash partitions, of which a sync writes those that hold a change."""
    root = work_path(spark, "store")
    for documents in (_reviewed_then(spark, folder), _reviewed_now(spark, folder)):
        ingest.sync_documents(spark, documents, root)
    return _sparse(store.read_store(spark, root), "chunk_id")


@_query
def sync_partition_cost(spark, folder):
    """What a sync writes when one document in a hundred has changed."""
    root, documents = work_path(spark, "store"), _documents(spark, folder)
    ingest.sync_documents(spark, documents, root)
    note = F.when(F.col("url").cast("long") % 100 == 0, "\nUnder review.").otherwise("")
    sync = ingest.sync_documents(spark, documents.withColumn("content", F.concat("content", note)), root)
    return store.sync_cost(spark, root, sync)


@_query
def sync_stream(spark, folder):
    """Two runs of the stream over the document table; the second finds nothing new."""
    root, checkpoint = work_path(spark, "stream"), work_path(spark, "checkpoint")
    for _ in range(2):
        sync.sync_stream(
            spark, f"{folder}/documents.parque[t]", RAW_DOCUMENTS, root, checkpoint, tables.documents_from_table
        )
    rows = sync.read_stream_index(spark, root)
    return rows.select("chunk_id", "url", "page_title", "text", "model")


@_query
def sync_stream_changes(spark, folder):
    """Earlier documents, then in one trigger a draft, a deletion and the later version of each; read compacted."""
    root, checkpoint, source, small = (work_path(spark, n) for n in ("stream", "checkpoint", "source", "compacted"))
    then, now = _reviewed_then(spark, folder), _reviewed_now(spark, folder)
    draft = then.withColumn("content", F.concat("content", F.lit("\nDraft.")))
    gone = then.withColumn("content", F.lit(None).cast("string"))
    schema = T.StructType([*DOCUMENTS.fields, T.StructField("seen", T.IntegerType())])
    for versions in ([then], [draft, gone, now]):
        for at, rows in enumerate(versions):
            rows.withColumn("seen", F.lit(at)).write.mode("append").parquet(source)
        sync.sync_stream(spark, source, schema, root, checkpoint, lambda df: df)
    sync.compact(spark, root, small)
    return _sparse(sync.read_stream_index(spark, small), "chunk_id")


@_query
def sync_stream_versions(spark, folder):
    """The same with versions in a state store: the earlier documents come last, and too late."""
    root, checkpoint, source = (work_path(spark, n) for n in ("stream", "checkpoint", "source"))
    then, now = _reviewed_then(spark, folder), _reviewed_now(spark, folder)
    gone = then.withColumn("content", F.lit(None).cast("string"))
    schema = T.StructType([*DOCUMENTS.fields, T.StructField("seen", T.IntegerType())])
    for versions in ([(0, then)], [(2, gone), (3, now)], [(1, then)]):
        for at, rows in versions:
            rows.withColumn("seen", F.lit(at)).write.mode("append").parquet(source)
        state.sync_stream_state(spark, source, schema, root, checkpoint, lambda df: df)
    return _sparse(sync.read_stream_index(spark, root), "chunk_id")


@_query
def check_models(spark, folder):
    """Given vectors and questions against the index: which models it lacks."""
    given = _table(spark, folder, "embeddings").select(F.lit("given").alias("model"), "embedding")
    asked = embedding.embed(_questions(spark, folder), "text").select("model", "embedding")
    built = index.build_index(_chunks(spark, folder))
    return index.check_models(built, given.unionByName(asked))


@_query
def latest_version(spark, folder):
    """Newest page number per site."""
    site = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    crawled = _pages(spark, folder).select(site.alias("site"), F.nullif(number, F.lit("")).alias("version"))
    return index.latest_version(crawled, "site")


# ---- retrieval


@_query
def topk_vector(spark, folder):
    given = _table(spark, folder, "embeddings")
    asked = given.select(F.col("vec_id").alias("query_id"), "embedding")
    return search.topk_vector(asked, given, 4, iid="vec_id")


@_query
def topk_vector_blocks(spark, folder):
    """The same by pairs of blocks, the form for very many questions."""
    given = _table(spark, folder, "embeddings")
    asked = given.select(F.col("vec_id").alias("query_id"), "embedding")
    return search.topk_vector(asked, given, 4, iid="vec_id", sent_questions=0)


@_query
def topk_bounded(spark, folder):
    """The same, leaving out blocks of items that cannot be near."""
    given = _table(spark, folder, "embeddings")
    asked = given.select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = bounded.block(given, ivf.fit(given, "vec_id", cells=16, codes=1, rounds=3).centres, "vec_id")
    return bounded.topk_bounded(asked, blocks, 4, iid="vec_id")


@_query
def topk_text(spark, folder):
    return search.topk_text(_questions(spark, folder), _index(spark, folder))


@_query
def topk_lexical(spark, folder):
    """BM25 over posting lists, with the blocks skipped that cannot matter."""
    return lexical.topk_lexical(_questions(spark, folder), lexical.build_lexical(_chunks(spark, folder), range_size=64), 4)


@_query
def retrieve(spark, folder):
    found = search.retrieve(_questions(spark, folder), _index(spark, folder))
    return found.select("query_id", F.explode("docs").alias("doc")).select(
        "query_id", "doc.rk", "doc.text", "doc.url", "doc.page_title"
    )


@_query
def topk_lsh(spark, folder):
    given = _table(spark, folder, "embeddings")
    asked = given.select(F.col("vec_id").alias("query_id"), "embedding")
    return search.topk_lsh(asked, given, 4, iid="vec_id")


@_query
def topk_lsh_cost(spark, folder):
    given = _table(spark, folder, "embeddings")
    return search.lsh_cost(given.withColumnRenamed("vec_id", "query_id"), given, iid="vec_id")


def _fixed_quantiser(given: DataFrame) -> ivf.Quantiser:
    """Directions and codewords that SQL can name: the first 16 vectors, and residuals of the next 16."""
    rows = given.where("vec_id < 32").orderBy("vec_id").collect()
    unit = np.array([r.embedding for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    made = ivf.Quantiser(unit[:16], np.zeros((8, 16, unit.shape[1] // 8)))
    words = made.parts(unit[16:] - made.centres[made.cell(unit[16:])])
    return ivf.Quantiser(made.centres, words.copy())


@_query
def topk_ivf(spark, folder):
    given = _table(spark, folder, "embeddings")
    asked = given.select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = _fixed_quantiser(given)
    inverted = ivf.build(given, quantiser, "vec_id")
    return ivf.topk_ivf(asked, given, inverted, quantiser, 4, n_probes=4, size=16, iid="vec_id")


@_query
def topk_ivf_cost(spark, folder):
    given = _table(spark, folder, "embeddings")
    quantiser = _fixed_quantiser(given)
    return ivf.ivf_cost(given.withColumnRenamed("vec_id", "query_id"), ivf.build(given, quantiser, "vec_id"), quantiser, 4, 16)


@_query
def one_per_url(spark, folder):
    """Sources taken as URLs: very many documents share one."""
    documents = tables.spread(_table(spark, folder, "documents"))
    rows = tables.documents_from_table(documents, url=F.col("source"), title=F.col("doc_id").cast("string"))
    sized = rows.withColumn("n", F.char_length("content"))
    return chunks.one_per_url(sized, F.col("n"))


@_query
def result_rows(spark, folder):
    hits = search.topk_text(_questions(spark, folder), _index(spark, folder))
    row = F.struct("rk", "url", "page_title", "text")
    nested = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("data_array"))
    nested = nested.select("query_id", F.struct("data_array").alias("result"))
    return search.result_rows(_questions(spark, folder).join(nested, "query_id", "left"))


# ---- dialogs and answers


@_query
def extract_question(spark, folder):
    return dialog.extract_question(_turns(spark, folder))


@_query
def extract_history(spark, folder):
    return dialog.extract_history(_turns(spark, folder))


@_query
def last_user_question(spark, folder):
    return dialog.extract_question(_turns(spark, folder), last_user=True)


@_query
def search_query(spark, folder):
    return dialog.search_query(_turns(spark, folder))


@_query
def search_vector(spark, folder):
    return _sparse(dialog.dialog_state(_turns(spark, folder)), "conv_id")


@_query
def rewrite_prompt(spark, folder):
    return dialog.prompts(_turns(spark, folder), "rewrite")


@_query
def rewrite_knn_prompt(spark, folder):
    return dialog.prompts(_turns(spark, folder), "rewrite_knn")


@_query
def gate_prompt(spark, folder):
    return dialog.prompts(_turns(spark, folder), "gate")


@_query
def topic_gate(spark, folder):
    """Documents as questions, with their toxicity as the mark."""
    rows = _labelled(spark, folder).select(
        "doc_id", "text", (F.col("toxic") == 1).alias("inappropriate")
    )
    asked = embedding.embed(rows, "text")
    gated = answers.topic_gate(
        asked, answers.topic_centroid(_index(spark, folder)), GATE, inappropriate="inappropriate"
    )
    return gated.select("doc_id", "topic_score", "question_is_relevant")


def _judged(spark, folder, built: DataFrame) -> DataFrame:
    return materialise(answering.judged_dialogs(_turns(spark, folder), built, GATE), "dialogs")


@_query
def route_dialogs(spark, folder):
    relevant, refused = answers.route(_judged(spark, folder, _index(spark, folder)))
    return (
        relevant.withColumn("branch", F.lit("answer"))
        .unionByName(refused.withColumn("branch", F.lit("refuse")))
        .select("conv_id", "branch")
    )


@_query
def refuse_dialogs(spark, folder):
    refused = answers.route(_judged(spark, folder, _index(spark, folder)))[1]
    return answers.refuse(refused).select("conv_id", "result", F.size("sources").alias("n_sources"))


def _found(spark, folder) -> DataFrame:
    built = _index(spark, folder)
    return answering.retrieved_dialogs(_judged(spark, folder, built), built)


@_query
def format_context(spark, folder):
    return _found(spark, folder).select("conv_id", answers.format_context(F.col("docs")).alias("context"))


@_query
def source_urls(spark, folder):
    return _found(spark, folder).select(
        "conv_id", F.posexplode(answers.source_urls(F.col("docs"))).alias("pos", "source")
    )


@_query
def answer_prompt(spark, folder):
    context = answers.format_context(F.col("docs")).alias("context")
    return dialog.prompts(
        _turns(spark, folder), "answer", extra=_found(spark, folder).select("conv_id", context)
    )


@_query
def answer_extractive(spark, folder):
    found = _found(spark, folder)
    return found.select("conv_id", answers.answer_extractive(F.col("question"), F.col("docs")).alias("result"))


@_query
def dialog_columns(spark, folder):
    """Fan-out: verdict, question and number of earlier messages from one input."""
    judged = _judged(spark, folder, _index(spark, folder))
    return judged.withColumns(
        {"n_history": F.col("n_turns") - 1, "has_history": F.col("n_turns") > 1}
    ).select("conv_id", "question_is_relevant", "topic_score", "question", "n_history", "has_history")


@_query
def pick_keys(spark, folder):
    return dialog.dialog_state(_turns(spark, folder)).select("conv_id", "question", "role")


@_query
def answer_struct(spark, folder):
    done = answering.answer_all(_turns(spark, folder), _index(spark, folder), threshold=GATE)
    return answers.answer_struct(done).select(
        "conv_id", F.col("answer.result").alias("result"), F.size("answer.sources").alias("n_sources")
    )


@_query
def answer_all(spark, folder):
    done = answering.answer_all(_turns(spark, folder), _index(spark, folder), threshold=GATE)
    return done.select("conv_id", "result", F.array_join("sources", "\n").alias("sources"))


@_query
def model_stage(spark, folder):
    """A stand-in model that counts the words of each text."""

    def count_words(texts: list[str]) -> list[str]:
        return [str(len(re.findall(r"\S+", t))) for t in texts]

    return models.model_stage(_questions(spark, folder), count_words, "text", "reply")


# ---- the chain with models of the user; these stand in for them and can be recomputed elsewhere


def _between(text: str, before: str, after: str) -> str:
    return text.rsplit(before, 1)[1].split(after, 1)[0]


STAND_INS = {
    "gate": lambda prompts: ["Yes" if len(_between(p, "New message: ", "\n\nFor instance")) % 3 else "No" for p in prompts],
    "rewrite": lambda prompts: [_between(p, "Next comes: ", "\n\nTurn what") + " policy" for p in prompts],
    "answer": lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts],
}


def _answered(spark, folder, always_rewrite: bool) -> DataFrame:
    message = F.struct("role", F.col("text").alias("content")).alias("m")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", message))), lambda x: x["m"])
    dialogs = _turns(spark, folder).groupBy("conv_id").agg(listed.alias("messages"))
    rows = answering.answer_dialogs(dialogs, _index(spark, folder), STAND_INS, always_rewrite=always_rewrite)
    return rows.select("conv_id", "result", F.array_join("sources", "\n").alias("sources"))


@_query
def answer_dialogs(spark, folder):
    """Gate, rewrite and answer by models; dialogs without history are searched by their question."""
    return _answered(spark, folder, False)


@_query
def answer_dialogs_always_rewritten(spark, folder):
    return _answered(spark, folder, True)


@_query
def model_batches(spark, folder):
    """A stand-in model on every turn, asked once per distinct text and in batches of like length."""

    def count(texts: list[str]) -> list[str]:
        return [str(len(re.findall(TOKEN, t, re.ASCII))) for t in texts]

    turns = _turns(spark, folder).select("conv_id", "turn", "text")
    return models.model_batches(turns, count, "text", "reply", budget=2000).select("conv_id", "turn", "reply")
