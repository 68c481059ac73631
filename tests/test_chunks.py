import re

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import chunks as C
from lectern.sources.tables import documents_from_table, read_table
from lectern.schemas import RAW_DOCUMENTS


def text(*sizes):
    """Paragraphs of the given numbers of tokens."""
    n, lines = 0, []
    for size in sizes:
        lines.append(" ".join(f"w{n + i}" for i in range(size)))
        n += size
    return "\n".join(lines)


def chunked(spark, content):
    df = spark.createDataFrame([("u", None, content)], "url string, page_title string, content string")
    return [(r.chunk_ix, r.text) for r in C.chunk_documents(df).orderBy("chunk_ix").collect()]


def sizes(spark, content):
    return [len(t.split()) for _, t in chunked(spark, content)]


def test_small_documents(spark):
    assert sizes(spark, text(20)) == []
    assert sizes(spark, text(21)) == [21]
    assert sizes(spark, "") == []
    assert sizes(spark, None) == []
    assert sizes(spark, " \n\n\t") == []


def test_merge_limit(spark):
    assert sizes(spark, text(125, 125)) == [250]
    assert sizes(spark, text(125, 126)) == [125, 126]
    assert sizes(spark, text(100, 100, 100, 100)) == [200, 200]


def test_first_paragraph_over_the_limit(spark):
    assert sizes(spark, text(300)) == [300]
    assert sizes(spark, text(300, 30)) == [300, 30]


def test_oversize(spark):
    got = chunked(spark, text(950))
    assert [len(t.split()) for _, t in got] == [500, 500]
    assert got[1][1].split()[0] == "w450"
    assert sizes(spark, text(500)) == [500]
    assert sizes(spark, text(501)) == [500, 51]
    assert sizes(spark, text(951)) == [500, 500, 51]


def test_line_breaks_stay_in_blocks_and_go_in_windows(spark):
    assert chunked(spark, text(30, 30))[0][1].count("\n") == 1
    assert "\n" not in chunked(spark, text(600))[0][1]


def brute(content):
    out, block, total = [], [], 0
    for line in [p for p in content.split("\n") if p.strip(" \n\t\r")]:
        n = len(re.findall(r"\S+", line, re.ASCII))
        if block and total + n <= 250:
            block.append(line)
            total += n
        else:
            if block:
                out.append("\n".join(block))
            block, total = [line], n
    if block:
        out.append("\n".join(block))
    pieces = []
    for b in out:
        words = re.findall(r"\S+", b, re.ASCII)
        if len(words) <= 500:
            pieces.append((b.strip(" \n\t\r"), len(words)))
        else:
            i = 0
            while True:
                pieces.append((" ".join(words[i : i + 500]), len(words[i : i + 500])))
                if i + 500 >= len(words):
                    break
                i += 450
    return [p for p, n in pieces if n > 20]


def test_all_documents_equal_brute_force_and_the_function(spark, folder):
    docs = documents_from_table(read_table(spark, f"{folder}/documents.parquet", RAW_DOCUMENTS))
    rows = C.chunk_documents(docs)
    got = {}
    for r in rows.orderBy("url", "chunk_ix").collect():
        assert 20 < r.n_tokens <= 500
        got.setdefault(r.url, []).append(r.text)
    for r in docs.collect():
        assert got.get(r.url, []) == brute(r.content)
    assert rows.select("chunk_id").distinct().count() == rows.count()
    by_function = docs.select("url", F.posexplode(C.chunk_udf()("content")).alias("chunk_ix", "text"))
    native = rows.select("url", "chunk_ix", "text")
    assert by_function.exceptAll(native).count() == native.exceptAll(by_function).count() == 0


def test_many_paragraphs(spark):
    """The fold stays usable on a document of very many paragraphs."""
    got = sizes(spark, text(*[10] * 20000))
    assert sum(got) == 200000 and set(got) == {250}


def test_null_arrays_give_no_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "url int, chunks array<string>")
    assert [(r.url, r.chunk_ix, r.chunk) for r in C.chunk_rows(df).collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_counter_of_the_user(spark):
    """A quarter of the characters, rounded up: paragraphs merge, long ones are cut between words, small ones go."""
    text = "\n".join(["aaaa bbbb", "cccc", "d" * 8 + " " + " ".join(["eeeeeeee"] * 20), "x"])
    rows = [("u", None, text), ("v", None, None), ("w", None, "")]
    df = spark.createDataFrame(rows, "url string, page_title string, content string")
    calls = []

    def count(texts):
        calls.append(len(texts))
        return [-(-len(t) // 4) for t in texts]

    chunk = C._chunker(12, 4, 1, count)
    assert calls == []
    got = chunk([text, None, ""])
    assert calls == [4, 21] and got[1:] == [[], []]
    eights = "eeeeeeee eeeeeeee eeeeeeee eeeeeeee eeeeeeee eeeeeeee"
    assert got[0][:2] == [("aaaa bbbb\ncccc", 4), ("d" * 8 + eights[8:], 12)]
    assert all(n <= 12 for _, n in got[0]) and got[0][2] == (eights, 12)
    found = C.chunk_documents(df, 12, 4, 1, count_tokens=count).orderBy("chunk_ix").collect()
    assert [(r.text, r.n_tokens) for r in found] == got[0] and {r.url for r in found} == {"u"}


def test_a_batch_is_chunked_some_texts_at_a_time(spark, monkeypatch):
    """A task held the words of a whole batch."""
    monkeypatch.setattr(C, "SLICE", 1000)
    sizes, chunker = [], C._chunker(500, 50, 20, C._count_runs)

    def noted(texts):
        sizes.append(sum(len(t or "") for t in texts))
        return chunker(texts)

    texts = [None, "", *[" ".join(["word"] * n) for n in (30, 2000, 100, 21, 20)], None]
    found = [row for some in C._sliced(pa.array(texts, pa.string()), noted) for row in some]
    assert found == chunker(texts) and len(sizes) > 2 and sum(x > 1000 for x in sizes) == 1
    assert list(C._sliced(pa.array([], pa.string()), chunker)) == [[]]
