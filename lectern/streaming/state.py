"""Triggered sync with the versions of URLs in a state store.

What is known of a URL (time and digest of its last version, and whether that
deleted it) is the state of a keyed operator, which Spark keeps and checkpoints
in the partition of the URL. So a trigger reads what arrived and the state of
the URLs that arrived, and no log of earlier triggers. The key is a hash bucket
of URLs: Spark calls Python once per key, which costs far more than a row, so a
key per URL would make that call the whole cost of a large trigger.

Versions count by their own time, not by their arrival. A late one changes
nothing, also when the URL was deleted since: a deletion is remembered for some
time, then forgotten, so that state does not grow with every URL that ever was.

Only keys, digests and the place of a row in its file go through the operator;
the texts of changed rows are read from the files that arrived. The result has
the layout of ``sync``, whose readers and compaction serve both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunks import chunk_documents
from ..operators.embedding import DIM
from ..operators.index import build_index
from ..operators.store import bucket_of
from ..session import materialise
from .sync import LOG

#: How long a deletion is remembered, in milliseconds.
REMEMBERED = 30 * 24 * 3600 * 1000
#: URLs share the state of a bucket. A checkpoint holds states by bucket, so the number is fixed.
BUCKETS = 4096
_STATE = "seen long, digest string, deleted boolean"
#: One item per URL of the bucket; ``until`` is when a deletion is forgotten, NULL for a URL that is there.
_BUCKET_STATE = "url array<string>, seen array<long>, digest array<string>, until array<long>"
_CHANGE = "url string, seen long, digest string, deleted boolean, change_type string, file string, row long"
_COLUMNS = [f.split()[0] for f in _CHANGE.split(", ")]


def _change_type(known: tuple | None, best: tuple) -> str | None:
    """What the newer of two versions ``(seen, digest, deleted)`` makes of a URL, if anything."""
    was_there, is_there = known is not None and not known[2], not best[2]
    if was_there and is_there:
        return "update" if known[1] != best[1] else None
    return "insert" if is_there else "delete" if was_there else None


def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, remembered: int = REMEMBERED) -> Iterator[pd.DataFrame]:
    """The change that the arrived versions of one URL make to its state, if any; batches are looked at one by one.

    The last version by time counts; of several of one time that with the
    larger digest, in whatever order and triggers they come.
    """
    if state.hasTimedOut:
        state.remove()
        return
    known = tuple(state.get) if state.exists else None
    best = known and (known[0], known[1], bool(known[2]))
    place = None
    for batch in batches:
        for seen, digest, deleted, file, row in zip(batch["seen"], batch["digest"], batch["deleted"], batch["file"], batch["row"], strict=True):
            if best is None or (seen, digest) > best[:2]:
                best, place = (int(seen), digest, bool(deleted)), (file, int(row))
    if place is None:
        # a timeout lapses when it is not set again
        if known and known[2]:
            state.setTimeoutDuration(remembered)
        return
    state.update(best)
    if best[2]:
        state.setTimeoutDuration(remembered)
    kind = _change_type(known, best)
    if kind:
        yield pd.DataFrame([(key[0], *best, kind, *place)], columns=_COLUMNS)


def newest_of_bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, remembered: int = REMEMBERED) -> Iterator[pd.DataFrame]:
    """The same for all URLs of a bucket in one call."""
    now = state.getCurrentProcessingTimeMs()
    held = list(zip(*state.get, strict=True)) if state.exists else []
    known = {url: (seen, digest, until is not None) for url, seen, digest, until in held}
    until = {url: at for url, _, _, at in held if at is not None}
    best, place, arrived = dict(known), {}, set()
    for batch in () if state.hasTimedOut else batches:
        for url, seen, digest, deleted, file, row in zip(*[batch[c].tolist() for c in ("url", "seen", "digest", "deleted", "file", "row")], strict=True):
            arrived.add(url)
            before = best.get(url)
            if before is None or (seen, digest) > before[:2]:
                best[url], place[url] = (seen, digest, deleted), (file, row)
    # also a late version makes a deletion be remembered anew
    for url in arrived:
        if best[url][2]:
            until[url] = now + remembered
        else:
            until.pop(url, None)
    forgotten = [url for url, at in until.items() if at < now]
    for url in forgotten:
        del best[url], until[url]
    if not best:
        state.remove()
    else:
        if place or forgotten or any(until.get(url) != at for url, _, _, at in held):
            state.update((list(best), [v[0] for v in best.values()], [v[1] for v in best.values()], [until.get(url) for url in best]))
        if until:
            # a timeout lapses when it is not set again
            state.setTimeoutDuration(max(1, min(until.values()) - now))
    changed = [(url, *best[url], _change_type(known.get(url), best[url]), *at) for url, at in place.items()]
    changed = [row for row in changed if row[4]]
    if changed:
        yield pd.DataFrame(changed, columns=_COLUMNS)


def changes(documents: DataFrame, remembered: int = REMEMBERED, per_url: bool = False) -> DataFrame:
    """A stream of documents with ``seen`` (a number or a time), ``file`` and ``row`` as the stream of its changes.

    ``per_url`` keeps a state for each URL, as checkpoints of earlier releases
    do; it reads less when few of very many URLs arrive, and calls Python for each.
    """
    digest = F.md5(F.to_json(F.struct("page_title", "content"), {"ignoreNullFields": "false"}))
    kind = documents.schema["seen"].dataType
    seen = F.unix_micros("seen") if isinstance(kind, T.TimestampType) else F.col("seen").cast("long")
    versions = documents.where("url IS NOT NULL").select(
        "url", F.coalesce(seen, F.lit(-(1 << 62))).alias("seen"), digest.alias("digest"), F.col("content").isNull().alias("deleted"), "file", "row"
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return (newest if per_url else newest_of_bucket)(key, batches, state, remembered)

    keyed = versions.groupBy("url") if per_url else versions.withColumn("bucket", bucket_of(F.col("url"), BUCKETS)).groupBy("bucket")
    held = _STATE if per_url else _BUCKET_STATE
    return keyed.applyInPandasWithState(step, _CHANGE, held, "Update", GroupStateTimeout.ProcessingTimeTimeout)


def write_changes(found: DataFrame, batch_id: int, read: Callable[[list[str]], DataFrame], root: str, dim: int = DIM, encoder=None, model=None) -> None:
    """Apply the changes of one trigger; a replay of the trigger rewrites the same folders.

    ``read`` gives the documents of files, with ``file`` and ``row``.
    """
    found = materialise(found, "changes")  # the operator runs once per trigger
    # as many names as the trigger had files with a change
    files = sorted(r.file for r in found.where("NOT deleted").select("file").distinct().collect())
    if files:
        live = read(files).join(found.where("NOT deleted").select("file", "row"), ["file", "row"], "left_semi")
        index = build_index(chunk_documents(live.select("url", "page_title", "content")), dim, encoder, model)
        index.write.mode("overwrite").parquet(f"{root}/chunks/batch_id={batch_id}")
    # the log comes last: readers follow the log, so they never see half a trigger
    found.select(*LOG.fieldNames()).write.mode("overwrite").parquet(f"{root}/log/batch_id={batch_id}")


def sync_stream_state(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    root: str,
    checkpoint: str,
    to_documents: Callable[[DataFrame], DataFrame],
    max_files: int | None = None,
    remembered: int = REMEMBERED,
    per_url: bool = False,
    **kw,
) -> None:
    """Process the files that arrived since the last run, then stop.

    ``to_documents`` gives url, page_title, content, the column ``_place`` that
    it gets, and ``seen``, the time of the version, if there is one; else the
    time of the file counts.
    A NULL content deletes the URL; a NULL time comes before all others. Rows
    without a URL take no part. A checkpoint keeps to the ``per_url`` that it
    was begun with; see ``changes``.
    """

    def with_place(df: DataFrame) -> DataFrame:
        """Documents with the place of their row, which is computed in the scan."""
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_modification_time").alias("time")
        )
        documents = to_documents(df.select("*", place.alias("_place")))
        if "_place" not in documents.columns:
            raise ValueError("to_documents has to keep the column _place")
        seen = F.col("seen") if "seen" in documents.columns else F.col("_place.time")
        return documents.select("url", "page_title", "content", seen.alias("seen"), "_place.file", "_place.row")

    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(found: DataFrame, batch_id: int) -> None:
        session = found.sparkSession
        write_changes(found, batch_id, lambda files: with_place(session.read.schema(schema).parquet(*files)), root, **kw)

    # a timeout by the clock would ask for one more trigger without end; state that timed out is dropped with the next data
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, "true")
    spark.conf.set(idle, "false")
    try:
        query = (
            changes(with_place(reader.parquet(source)), remembered, per_url)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(idle, before)
    query.awaitTermination()
