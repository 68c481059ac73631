import pytest

from lectern.operators.chunks import chunk_documents
from lectern.operators.index import build_index, sync_index
from lectern.schemas import DOCUMENTS
from lectern.session import work_path
from lectern.streaming import sync as S

WORDS = " ".join(f"word{i}" for i in range(30))


def docs(spark, urls, note=""):
    return spark.createDataFrame([(u, "T", f"{WORDS} {u} {note}") for u in urls], DOCUMENTS)


def rows(df):
    return sorted((r.chunk_id, r.url, r.page_title, r.text, r.model, tuple(r.embedding)) for r in df.collect())


def log_rows(spark, root):
    return spark.read.parquet(f"{root}/log").count()


def test_three_runs(spark):
    source, root, checkpoint = (work_path(spark, n) for n in ("source", "stream", "checkpoint"))

    def run():
        S.sync_stream(spark, source, DOCUMENTS, root, checkpoint, lambda df: df)
        return S.read_stream_index(spark, root)

    first = docs(spark, [f"u{i}" for i in range(10)])
    first.write.parquet(source)
    assert rows(run()) == rows(build_index(chunk_documents(first)))
    assert log_rows(spark, root) == 10

    # five seen before, five new
    docs(spark, [f"u{i}" for i in range(5, 15)]).write.mode("append").parquet(source)
    run()
    assert log_rows(spark, root) == 15
    run()
    assert log_rows(spark, root) == 15

    # one changed, one deleted, one that never existed deleted
    changed = docs(spark, ["u1"], "changed")
    gone = spark.createDataFrame([("u2", None, None), ("never", None, None)], DOCUMENTS)
    changed.unionByName(gone).write.mode("append").parquet(source)
    index = run()
    now = docs(spark, [f"u{i}" for i in range(15) if i not in (1, 2)]).unionByName(changed)
    assert rows(index) == rows(build_index(chunk_documents(now)))
    # the batch path gives the same index
    batch = sync_index(build_index(chunk_documents(first)), chunk_documents(now))
    assert rows(index) == rows(batch)


def test_replay_of_a_batch_changes_nothing(spark):
    root = work_path(spark, "stream")
    a, b = docs(spark, ["a", "b"]), docs(spark, ["b", "c"])
    S.write_batch(spark, a, 0, root)
    S.write_batch(spark, b, 1, root)
    before = rows(S.read_stream_index(spark, root))
    for _ in range(2):
        S.write_batch(spark, b, 1, root)
    assert rows(S.read_stream_index(spark, root)) == before
    assert log_rows(spark, root) == 3


def test_a_batch_without_its_log_is_not_read(spark):
    root = work_path(spark, "stream")
    S.write_batch(spark, docs(spark, ["a"]), 0, root)
    half = build_index(chunk_documents(docs(spark, ["b"])))
    half.write.parquet(f"{root}/chunks/batch_id=1")
    assert {r.url for r in S.read_stream_index(spark, root).collect()} == {"a"}


def test_one_version_per_url_in_a_batch(spark):
    root = work_path(spark, "stream")
    both = docs(spark, ["a"], "one").unionByName(docs(spark, ["a"], "two"))
    S.write_batch(spark, both, 0, root)
    assert log_rows(spark, root) == 1
    assert S.read_stream_index(spark, root).count() == 1


@pytest.mark.parametrize("contents, left", [(["old", "new"], "new"), (["new", None, "back"], "back"), (["new", None], None)])
def test_the_last_seen_version_of_a_batch_counts(spark, contents, left):
    text = "word " * 30
    rows_ = [("u", "t", c and text + c, at) for at, c in enumerate(contents)]
    for order in (rows_, rows_[::-1]):
        root = work_path(spark, "stream")
        S.write_batch(spark, spark.createDataFrame(order, "url string, page_title string, content string, seen int"), 0, root)
        got = [r.text for r in S.read_stream_index(spark, root).collect()]
        assert got == ([text + left] if left else [])


def test_compaction_keeps_the_index_and_goes_on(spark):
    root, small = work_path(spark, "stream"), work_path(spark, "compacted")
    S.write_batch(spark, docs(spark, ["a", "b", "c"]), 0, root)
    gone = spark.createDataFrame([("b", None, None)], DOCUMENTS)
    S.write_batch(spark, docs(spark, ["a"], "changed").unionByName(gone), 1, root)
    S.compact(spark, root, small)
    assert rows(S.read_stream_index(spark, small)) == rows(S.read_stream_index(spark, root))
    assert log_rows(spark, small) == 2 and spark.read.parquet(f"{small}/chunks").count() == S.read_stream_index(spark, root).count()
    for where in (root, small):
        S.write_batch(spark, docs(spark, ["a", "c", "d"], "changed"), 2, where)
    assert rows(S.read_stream_index(spark, small)) == rows(S.read_stream_index(spark, root))
