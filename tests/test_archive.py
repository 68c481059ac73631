from lectern.session import work_path
from lectern.sources import archive

PAGES = [(1, "https://h/a", "<p>one</p>\n\r\n\r\ntwo"), (2, "https://h/b?x=ü", "ü" * 500), (3, "https://h/c", None), (4, "https://h/d", "gone")]


def written(spark, rows, **kw):
    path = work_path(spark, "archive")
    archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, **kw)
    return path


def test_there_and_back(spark):
    from pyspark.sql import functions as F

    path = written(spark, PAGES, status=F.when(F.col("page_id") == 4, 404).otherwise(200))
    records = archive.read_archive(spark, path)
    assert {(r.page_id, r.status, r.problem) for r in records.collect()} == {(1, 200, None), (2, 200, None), (3, 200, None), (4, 404, None)}
    assert sorted(map(tuple, archive.archived_pages(records).collect())) == [*PAGES[:2], (3, "https://h/c", "")]
    assert archive.archive_problems(records).count() == 0


def test_files_are_read_in_splits(spark):
    rows = [(i, f"https://h/{i}", f"{i} " * (i % 300)) for i in range(2000)]
    path = written(spark, rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = archive.read_archive(spark, path)
        assert records.rdd.getNumPartitions() > 10
        assert sorted(map(tuple, archive.archived_pages(records).collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corrupt_records_are_reported_and_others_stay(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {0}\r\nWARC-Target-URI: https://h/{0}\r\nContent-Length: {1}\r\n\r\n{2}\r\n\r\n"
    body = "HTTP/1.1 200 OK\r\n\r\n<p>{}</p>"
    parts = [
        "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        record.format(1, len(body.format(1)), body.format(1)),
        record.format(2, 999, body.format(2)),  # cut off
        record.format(3, len("no response"), "no response"),
        record.format(4, "many", body.format(4)),
        "WARC/1.0\r\nnothing of use\r\n\r\n\r\n\r\n",
        record.format(5, len(body) + 40, body + " quoting \r\n\r\nWARC/1.0\r\n a record"),
        record.format(6, len(body.format(6)), body.format(6)),
    ]
    file = tmp_path / "a.warc"
    file.write_bytes("".join(parts).encode())
    records = archive.read_archive(spark, str(file))
    assert [r.page_id for r in archive.archived_pages(records).orderBy("page_id").collect()] == [1, 6]
    assert {r.problem: r.n_records for r in archive.archive_problems(records).collect()} == {
        "other length": 2, "no response": 1, "no length": 1, "headers are missing": 2,
    }
    gz = tmp_path / "b.warc.gz"
    import gzip

    gz.write_bytes(gzip.compress(file.read_bytes()))
    assert sorted(map(str, archive.read_archive(spark, str(gz)).collect())) == sorted(map(str, records.collect()))
