import pytest
from pyspark.sql import functions as F

from lectern.operators import store
from lectern.operators.chunks import chunk_documents
from lectern.operators.index import build_index
from lectern.schemas import DOCUMENTS, INDEX
from lectern.session import work_path

WORDS = " ".join(f"word{i}" for i in range(30))


def chunks(spark, names, note=lambda name: ""):
    return chunk_documents(spark.createDataFrame([(n, None if n == "u3" else "T", f"{WORDS} {n} {note(n)}") for n in names], DOCUMENTS))


def rows(df):
    return sorted((r.chunk_id, r.url, r.page_title, r.text, r.model, tuple(r.embedding)) for r in df.collect())


def files(spark, root):
    """Names of the files of each partition."""
    found = spark.read.parquet(f"{root}/rows").select("bucket", F.input_file_name().alias("file")).distinct().collect()
    return {(r.bucket, r.file) for r in found}


NAMES = [f"u{i}" for i in range(60)]


def test_a_sync_equals_a_fresh_build_and_rewrites_only_what_changed(spark):
    root = work_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, root)
    made = store.sync_store(spark, root, chunks(spark, NAMES), buckets=16)
    assert made.written == list(range(16)) and store.buckets_of(spark, root) == 16
    assert store.read_store(spark, root).schema.simpleString() == INDEX.simpleString()
    assert rows(store.read_store(spark, root)) == rows(build_index(chunks(spark, NAMES)))
    before = files(spark, root)

    now = chunks(spark, [n for n in NAMES if n != "u7"] + ["new"], lambda n: "changed" if n == "u5" else "")
    sync = store.sync_store(spark, root, now)
    assert sorted(r.change_type for r in sync.changes.collect()) == ["delete", "insert", "update"]
    assert rows(store.read_store(spark, root)) == rows(build_index(now))
    after = files(spark, root)
    assert 0 < len(sync.written) <= 3
    assert {f for f in before if f[0] not in sync.written} == {f for f in after if f[0] not in sync.written}
    assert not {f for f in before if f[0] in sync.written} & after

    again = store.sync_store(spark, root, now)
    assert again.written == [] and files(spark, root) == after
    cost = store.sync_cost(spark, root, sync).first()
    assert (cost.n_buckets, cost.n_written, cost.n_rows, cost.n_changed) == (16, len(sync.written), 60, 3)
    assert cost.n_rewritten < 60


def test_a_partition_that_loses_all_rows(spark):
    root = work_path(spark, "store")
    store.sync_store(spark, root, chunks(spark, NAMES[:4]), buckets=32)
    store.sync_store(spark, root, chunks(spark, NAMES[:1]))
    assert {r.url for r in store.read_store(spark, root).collect()} == {"u0"}
    store.sync_store(spark, root, chunks(spark, []))
    assert store.read_store(spark, root).count() == 0
    store.sync_store(spark, root, chunks(spark, NAMES[:4]))
    assert rows(store.read_store(spark, root)) == rows(build_index(chunks(spark, NAMES[:4])))


def test_a_sync_that_ended_half_way_is_completed(spark):
    """Some partitions hold the new rows already, others the old ones."""
    root, other = work_path(spark, "store"), work_path(spark, "store")
    now = chunks(spark, NAMES[10:] + ["new"], lambda n: "changed" if n < "u3" else "")
    for path in (root, other):
        store.sync_store(spark, path, chunks(spark, NAMES), buckets=8)
    store.sync_store(spark, other, now)
    half = spark.read.schema(store._STORED).parquet(f"{other}/rows").where("bucket < 4")
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/rows")
    sync = store.sync_store(spark, root, now)
    assert min(sync.written) >= 4
    assert rows(store.read_store(spark, root)) == rows(build_index(now))


def test_only_changes_are_embedded(spark):
    """Also where the encoder has no vector for a text: that is stored as known, and not asked again."""
    root = work_path(spark, "store")

    def lengths(texts):
        return [None if "u1 " in t + " " else [float(len(t)), 1.0] for t in texts]

    def fails(texts):
        raise AssertionError("nothing to embed")

    store.sync_store(spark, root, chunks(spark, NAMES[:4]), encoder=lengths, model="length", buckets=4)
    assert {r.url for r in store.read_store(spark, root).collect()} == {"u0", "u2", "u3"}
    assert store.sync_store(spark, root, chunks(spark, NAMES[:4]), encoder=fails, model="length").written == []
    # another model: everything is embedded again
    assert len(store.sync_store(spark, root, chunks(spark, NAMES[:4]), dim=32).changes.collect()) == 4
    assert {r.model for r in store.read_store(spark, root).collect()} == {"hashed-words-32"}


def test_a_sync_reads_keys_and_digests_only(spark):
    root = work_path(spark, "store")
    store.sync_store(spark, root, chunks(spark, NAMES[:4]), buckets=4)
    held = store._stored(spark, root).select("chunk_id", "digest")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chunk_id:string,digest:string>" in plan


def test_a_repeated_key_is_refused(spark):
    twice = chunks(spark, ["a"]).unionByName(chunks(spark, ["a"]))
    with pytest.raises(ValueError):
        store.sync_store(spark, work_path(spark, "store"), twice)
