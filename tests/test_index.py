import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators.chunks import chunk_documents
from lectern.operators.embedding import embed
from lectern.plans import ingest
from lectern.schemas import CHUNKS, INDEX, conform
from lectern.session import work_path
from lectern.sources import tables

WORDS = " ".join(f"word{i}" for i in range(30))


def documents(spark, rows):
    return spark.createDataFrame(rows, "url string, page_title string, content string")


OLD = [("a", "A", WORDS + " a"), ("b", "B", WORDS + " b"), ("c", None, WORDS + " c")]
NEW = [("a", "A", WORDS + " a"), ("b", "B", WORDS + " changed"), ("d", "D", WORDS + " d")]


def rows(df):
    return sorted((r.chunk_id, r.url, r.page_title, r.text, tuple(r.embedding)) for r in df.collect())


def test_snapshot_diff(spark):
    changes = I.snapshot_diff(documents(spark, OLD), documents(spark, NEW), "url", ["page_title", "content"])
    assert {tuple(r) for r in changes.collect()} == {("b", "update"), ("c", "delete"), ("d", "insert")}


def test_snapshot_diff_sees_nulls_and_compares_repeated_keys_as_bags(spark):
    old = documents(spark, [("a", None, "x"), ("b", "", "x")] + [("hot", "t", str(i % 3)) for i in range(300)])
    new = documents(spark, [("a", "", "x"), ("b", "", "x")] + [("hot", "t", str(i % 3)) for i in reversed(range(300))])
    cols = ["page_title", "content"]
    assert [tuple(r) for r in I.snapshot_diff(old, new, "url", cols).collect()] == [("a", "update")]
    more = new.unionByName(documents(spark, [("hot", "t", "0")]))
    assert {r.url for r in I.snapshot_diff(old, more, "url", cols).collect()} == {"a", "hot"}


def test_sync_equals_a_fresh_build_and_embeds_only_changes(spark):
    old = I.build_index(chunk_documents(documents(spark, OLD)))
    new = chunk_documents(documents(spark, NEW))
    synced = I.sync_index(old, new)
    assert synced.schema.simpleString() == INDEX.simpleString()
    assert rows(synced) == rows(I.build_index(new))
    assert rows(I.sync_index(synced, new)) == rows(synced)


def test_sync_embeds_again_for_another_model(spark):
    chunks = chunk_documents(documents(spark, OLD))
    old = I.build_index(chunks, dim=32)
    assert {r.model for r in I.sync_index(old, chunks, dim=64).select("model").collect()} == {"hashed-words-64"}


def test_sync_with_a_model_of_the_user(spark):
    chunks = chunk_documents(documents(spark, OLD))
    built = I.build_index(chunks, encoder=lambda ts: [[float(len(t)), 1.0] for t in ts], model="length")
    assert {r.model for r in built.collect()} == {"length"}

    def fails(texts):
        raise AssertionError("nothing to embed")

    again = I.sync_index(built, chunks, encoder=fails, model="length")
    assert again.count() == 3


def test_upsert_creates_then_syncs_and_reruns(spark):
    root = work_path(spark, "index")
    assert not I.index_exists(spark, root)
    with pytest.raises(FileNotFoundError):
        I.read_index(spark, root)
    first = ingest.index_documents(spark, documents(spark, OLD), root)
    assert {r.url for r in first.collect()} == {"a", "b", "c"}
    second = ingest.index_documents(spark, documents(spark, NEW), root)
    third = ingest.index_documents(spark, documents(spark, NEW), root)
    assert {r.url for r in second.collect()} == {"a", "b", "d"}
    assert rows(third) == rows(second)
    # a reader of the first version still has it
    assert {r.url for r in first.collect()} == {"a", "b", "c"}


def test_an_unfinished_version_is_not_read(spark):
    root = work_path(spark, "index")
    ingest.index_documents(spark, documents(spark, OLD), root)
    half = spark.range(1).select(F.lit("x").alias("chunk_id"))
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/version-000002")
    assert I.read_index(spark, root).count() == 3


def test_check_models(spark):
    index = I.build_index(chunk_documents(documents(spark, OLD)))
    asked = spark.createDataFrame([(1, "word1")], "query_id int, text string")
    assert I.check_models(index, embed(asked, "text")).count() == 0
    other = embed(asked, "text", dim=32)
    assert [(r.model, r.dim, r.n) for r in I.check_models(index, other).collect()] == [("hashed-words-32", 32, 1)]
    with pytest.raises(ValueError):
        I.require_same_model(index, other)


def test_latest_version(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("n", None), ("o", "0")], "name string, version string")
    assert {tuple(r) for r in I.latest_version(df, "name").collect()} == {("m", 10), ("n", 1), ("o", 1)}
    assert {tuple(r) for r in I.latest_rows(df.where("name = 'm'"), "name").collect()} == {("m", "10")}


def test_write_read_and_create_table(spark):
    path = work_path(spark, "t")
    chunks = chunk_documents(documents(spark, OLD))
    for _ in range(2):
        tables.write_table(chunks, path)
    assert tables.read_table(spark, path, CHUNKS).count() == 3
    for _ in range(2):
        made = tables.create_table_as("chunk_table_test", chunks, work_path(spark, "ctas"))
    assert made.count() == 3
    assert tables.read_table(spark, "chunk_table_test", CHUNKS).count() == 3
    with pytest.raises(TypeError):
        conform(chunks.withColumn("text", F.lit(1)), CHUNKS)


def test_all_null_content_keeps_its_type(spark):
    from lectern.operators.pages import documents_from_pages

    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    path = work_path(spark, "docs")
    tables.write_table(documents_from_pages(pages), path)
    assert dict(spark.read.parquet(path).dtypes)["content"] == "string"


def test_load_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<section id='book-content'>text</section>", 200), (2, "v", "<p>no</p>", 200), (3, "w", "", 500)],
        "page_id long, url string, html string, status int",
    )
    loaded = ingest.load_pages(spark, pages, work_path(spark, "docs"), "status")
    assert [tuple(r) for r in loaded.collect()] == [("u", None, "text")]


def test_one_row_per_url(spark, tmp_path):
    from lectern.operators import chunks, search
    from lectern.plans import ingest

    text = "word " * 30
    rows = [("u", "a", text + "old"), ("u", "b", text + "new"), ("v", None, text)]
    documents = spark.createDataFrame(rows, "url string, page_title string, content string")
    assert [tuple(r) for r in chunks.repeated_urls(documents).collect()] == [("u", 2)]
    with pytest.raises(ValueError, match="several rows"):
        ingest.index_documents(spark, documents, str(tmp_path / "bad"))
    single = chunks.one_per_url(documents.withColumn("fetched", documents.page_title), F.col("fetched"))
    index = ingest.index_documents(spark, single, str(tmp_path / "good"))
    assert sorted((r.url, r.page_title) for r in index.collect()) == [("u", "b"), ("v", None)]
    asked = spark.createDataFrame([(1, "word new")], "query_id long, text string")
    assert [r.rk for r in search.topk_text(asked, index, 2).orderBy("rk").collect()] == [1, 2]


def test_vector_lengths_and_large_versions(spark):
    index = spark.createDataFrame([("m", [1.0, 0.0])], "model string, embedding array<float>")
    asked = spark.createDataFrame([("m", [1.0, 0.0, 0.0])], "model string, embedding array<float>")
    I.require_same_model(index, index)
    with pytest.raises(ValueError, match="numbers"):
        I.require_same_model(index, asked)
    df = spark.createDataFrame([("m", "20240101120000"), ("m", "3")], "name string, version string")
    assert I.latest_version(df, "name").first().latest_version == 20240101120000
    assert I.latest_rows(df, "name").first().version == "20240101120000"
