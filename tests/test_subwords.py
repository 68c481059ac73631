import random

import pytest

from lectern.operators import subwords
from lectern.operators.chunks import chunk_documents
from lectern.plans.catalog import VOCABULARY

SIGNS = "ab Z09 '\n\t  .,<|>_-éß\xa0Ж日本s'll don't“x”—the and of ing er"


@pytest.fixture(scope="module")
def ranks(spark):
    return subwords.read_ranks(spark, VOCABULARY)


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 120))) for _ in range(n)] + ["", " ", "\n\n", " lead", "trail  ", "a  b\n c", "x" * 300]


def test_a_plain_loop_by_hand():
    ranks = {b"b": 0, b"ab": 3, b"bc": 1, b"abc": 9, b"bcbc": 2}
    assert subwords.merged(b"abcbc", ranks) == [b"a", b"bcbc"]
    assert subwords.merged(b"abc", ranks) == [b"abc"]
    assert subwords.merged(b"aab", ranks) == [b"a", b"ab"]
    assert subwords.merged(b"", ranks) == [] and subwords.merged(b"q", ranks) == [b"q"]


def test_counts_are_those_of_the_library(spark, ranks):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    made = texts(300)
    want = [len(known.encode(t, add_special_tokens=False).ids) for t in made]
    df = spark.createDataFrame([*enumerate(made), (-1, None)], "id int, text string")
    got = {r.id: r.n_tokens for r in subwords.subword_counts(df, ranks, "id", "text").collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(made))] == want
    assert subwords.subword_counter(ranks)(made) == want
    assert all(b"".join(subwords.merged(t.encode(), ranks)) == t.encode() for t in made[:50])


def test_the_chunker_counts_subwords(spark, ranks):
    body = "\n".join(f"Line {i} tells of incomprehensibilities and antidisestablishmentarianism." for i in range(60))
    documents = spark.createDataFrame([("u", "T", body)], "url string, page_title string, content string")
    counter = subwords.subword_counter(ranks)
    rows = chunk_documents(documents, count_tokens=counter).collect()
    plain = chunk_documents(documents).collect()
    assert len(rows) > len(plain)
    assert all(20 < r.n_tokens <= 250 for r in rows)


@pytest.mark.parametrize("bits", [0, 6, 40])
def test_words_that_travel_and_words_that_are_joined_count_alike(spark, ranks, monkeypatch, bits):
    monkeypatch.setattr(subwords, "SLICE", 50)
    made = texts(120) + ["the of the"] * 30
    df = spark.createDataFrame([*enumerate(made), (-1, None)], "id int, text string").repartition(3)
    got = {r.id: r.n_tokens for r in subwords.subword_counts(df, ranks, "id", "text", sent_bits=bits).collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(made))] == subwords.subword_counter(ranks)(made)


def test_distinct_words_do_not_pass_through_the_driver(spark, ranks):
    """They were sent to all tasks, sixteen times each, where their file was small enough."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(50))], "id int, text string")
    plan = subwords.subword_counts(df, ranks, "id", "text")._jdf.queryExecution().toString()
    words = plan[plan.index("Optimized Logical Plan") :]
    assert "strategy=merge" in words and "sequence(0, 15" not in plan
