import pandas as pd
import pytest
from pyspark.sql import types as T

from lectern.operators.chunks import chunk_documents
from lectern.operators.index import build_index
from lectern.schemas import DOCUMENTS
from lectern.session import work_path
from lectern.streaming import state as S
from lectern.streaming.sync import compact, read_stream_index

WORDS = " ".join(f"word{i}" for i in range(30))
SCHEMA = T.StructType([*DOCUMENTS.fields, T.StructField("seen", T.IntegerType())])


class Stream:
    """A folder of files, and the index that follows it; each run is a query of its own."""

    def __init__(self, spark):
        self.spark = spark
        self.source, self.root, self.checkpoint = (work_path(spark, n) for n in ("source", "stream", "checkpoint"))

    def run(self, *rows, **kw):
        """Rows are (url, note, seen); a note of None deletes."""
        data = [(u, "T", note and f"{WORDS} {u} {note}", seen) for u, note, seen in rows]
        if data:
            self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        S.sync_stream_state(self.spark, self.source, SCHEMA, self.root, self.checkpoint, lambda df: df, **kw)
        index = read_stream_index(self.spark, self.root)
        return {r.url: r.text.split()[-1] for r in index.collect()}

    def log(self):
        rows = self.spark.read.parquet(f"{self.root}/log").collect()
        return sorted((r.batch_id, r.url, r.deleted) for r in rows)


def test_versions_across_restarts(spark):
    stream = Stream(spark)
    assert stream.run(("a", "one", 10), ("b", "one", 10), ("a", "zero", 5)) == {"a": "one", "b": "one"}
    # a late version, the same content again, and a new one
    assert stream.run(("a", "late", 7), ("b", "one", 20), ("c", "one", 20)) == {"a": "one", "b": "one", "c": "one"}
    assert stream.log()[2:] == [(1, "c", False)]
    # deleted, and a version that was made before the deletion
    assert stream.run(("a", None, 30), ("never", None, 30)) == {"b": "one", "c": "one"}
    assert stream.run(("a", "late", 25)) == {"b": "one", "c": "one"}
    # inserted again; several versions at once, in any order
    assert stream.run(("a", "back", 40), ("b", "three", 43), ("b", "two", 42), ("c", None, 41), ("c", "again", 42)) == {
        "a": "back", "b": "three", "c": "again",
    }
    assert stream.run() == {"a": "back", "b": "three", "c": "again"}
    assert [x for x in stream.log() if x[1] in ("never", "a")] == [(0, "a", False), (2, "a", True), (4, "a", False)]


def test_a_trigger_reads_no_log(spark):
    """The log of earlier triggers may be unreadable."""
    stream = Stream(spark)
    stream.run(("a", "one", 1), ("b", "one", 1))
    spark.range(1).write.mode("overwrite").parquet(f"{stream.root}/log/batch_id=0")
    stream.run(("a", "one", 2), ("b", "two", 2))
    assert [r.url for r in spark.read.schema("url string").parquet(f"{stream.root}/log/batch_id=1").collect()] == ["b"]


def test_the_index_is_that_of_the_batch_path(spark):
    stream, small = Stream(spark), work_path(spark, "compacted")
    stream.run(*[(f"u{i}", "one", i) for i in range(20)], max_files=1)
    stream.run(*[(f"u{i}", "two" if i % 3 else None, 100) for i in range(10)])
    now = [(f"u{i}", "T", f"{WORDS} u{i} {'two' if i < 10 else 'one'}") for i in range(20) if i % 3 or i >= 10]
    want = build_index(chunk_documents(spark.createDataFrame(now, DOCUMENTS)))

    def rows(df):
        return sorted((r.chunk_id, r.text, tuple(r.embedding)) for r in df.collect())

    assert rows(read_stream_index(spark, stream.root)) == rows(want)
    compact(spark, stream.root, small)
    assert rows(read_stream_index(spark, small)) == rows(want)


def test_times_of_files_count_where_versions_have_none(spark):
    source, root, checkpoint = (work_path(spark, n) for n in ("source", "stream", "checkpoint"))
    for note in ("one", "two"):
        spark.createDataFrame([("a", "T", f"{WORDS} {note}")], DOCUMENTS).write.mode("append").parquet(source)
        S.sync_stream_state(spark, source, DOCUMENTS, root, checkpoint, lambda df: df)
        assert [r.text.split()[-1] for r in read_stream_index(spark, root).collect()] == [note]
    with pytest.raises(ValueError):
        S.sync_stream_state(spark, source, DOCUMENTS, root, checkpoint + "2", lambda df: df.drop("_place"))


class Held:
    """A state by hand."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, duration):
        self.timeout = duration


def step(held, *versions):
    rows = pd.DataFrame(versions, columns=["seen", "digest", "deleted", "file", "row"])
    return [r["change_type"] for df in S.newest(("u",), iter([rows]), held, 99) for r in df.to_dict("records")]


def test_only_deletions_are_forgotten():
    held = Held()
    assert step(held, (1, "x", False, "f", 0)) == ["insert"] and held.timeout is None
    assert step(held, (2, "n", True, "f", 0)) == ["delete"] and held.timeout == 99
    held.timeout = None
    assert step(held, (1, "x", False, "f", 0)) == [] and held.timeout == 99  # late: still remembered
    held.hasTimedOut = True
    assert step(held) == [] and not held.exists
    held.hasTimedOut = False
    assert step(held, (1, "x", False, "f", 0)) == ["insert"]


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_equal_times_go_by_digest_in_any_order(order):
    versions = [(1, "x", False, "f", 0), (1, "y", False, "f", 1)]
    one, two = Held(), Held()
    step(one, *[versions[i] for i in order])
    for i in order:
        step(two, versions[i])
    assert one.value == two.value == (1, "y", False)


def test_urls_share_states_and_calls(spark, monkeypatch):
    """The operator is called, and keeps a state, per bucket; a state per URL gives the same changes."""
    runs = [
        [(f"u{i}", "one", 10) for i in range(60)],
        [(f"u{i}", None if i % 4 == 0 else "two" if i % 4 == 1 else "one", 20) for i in range(40)] + [("never", None, 20), (None, "one", 20)],
        [(f"u{i}", "late", 15) for i in range(30)] + [("u0", "back", 30), ("u0", "draft", 25), ("new", "one", 5)],
    ]
    monkeypatch.setattr(S, "BUCKETS", 7, raising=False)
    found = []
    for kw in ({}, {"per_url": True}):
        stream = Stream(spark)
        found.append(([stream.run(*rows, **kw) for rows in runs], stream.log()))
        states = spark.read.format("statestore").load(stream.checkpoint).count()
        assert states == (62 if kw else 7)
    assert found[0] == found[1]


class Clock(Held):
    """A state by hand that is called at a time."""

    now = 0

    def getCurrentProcessingTimeMs(self):
        return self.now


def step_at(held, now, *versions):
    held.now, held.timeout = now, None
    rows = pd.DataFrame(versions, columns=["url", "seen", "digest", "deleted", "file", "row"])
    return [(r["url"], r["change_type"]) for df in S.newest_of_bucket((0,), iter([rows[:1], rows[1:]]), held, 100) for r in df.to_dict("records")]


def test_each_deletion_of_a_bucket_has_its_time():
    held = Clock()
    assert step_at(held, 0, ("a", 1, "x", False, "f", 0), ("b", 1, "x", False, "f", 1)) == [("a", "insert"), ("b", "insert")]
    assert held.timeout is None
    assert step_at(held, 10, ("a", 2, "n", True, "f", 0)) == [("a", "delete")] and held.timeout == 100
    assert step_at(held, 20, ("c", 2, "n", True, "f", 0)) == [] and held.timeout == 90
    # late: still remembered, and for longer; also at a time when it was due
    assert step_at(held, 30, ("a", 1, "x", False, "f", 0)) == [] and held.timeout == 90
    assert step_at(held, 125, ("c", 1, "x", False, "f", 0)) == [] and held.timeout == 5
    # one is forgotten, as it was due when versions of others came; then the other, by the timeout
    assert step_at(held, 140, ("b", 0, "x", False, "f", 0)) == [] and held.timeout == 85
    assert sorted(held.value[0]) == ["b", "c"]
    held.hasTimedOut = True
    assert step_at(held, 226) == [] and held.value == (["b"], [1], ["x"], [None]) and held.timeout is None
    held.hasTimedOut = False
    assert step_at(held, 230, ("a", 1, "x", False, "f", 0), ("c", 1, "x", False, "f", 0)) == [("a", "insert"), ("c", "insert")]


def test_a_bucket_of_forgotten_urls_keeps_no_state():
    held = Clock()
    assert step_at(held, 0, ("a", 1, "n", True, "f", 0)) == [] and held.exists
    held.hasTimedOut = True
    assert step_at(held, 101) == [] and not held.exists
