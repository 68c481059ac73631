import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import BLANKS
from lectern.operators.splitting import SEPARATORS, chunk_recursively, parts_of, split_recursively


def count(text):
    return len(re.findall(r"\S+", text, re.ASCII))


def parts(text, most, separators):
    """Part by part, separator by separator."""
    if count(text) <= most or not separators:
        return [text] if text else []
    pieces = text.split(separators[0])
    pieces = [p + separators[0] for p in pieces[:-1]] + pieces[-1:]
    return [q for p in pieces if p for q in parts(p, most, separators[1:])]


def chunks(text, most, overlap, separators):
    made, held = [], []
    for p in parts(text, most, separators):
        n, total = count(p), sum(map(count, held))
        if total and total + n > most:
            made.append(held)
            held = held[1:]
            while held and (sum(map(count, held)) > overlap or sum(map(count, held)) + n > most):
                held = held[1:]
        held = held + [p]
    made += [held] if held else []
    return [("".join(h).strip(BLANKS), sum(map(count, h))) for h in made if any(map(count, h))]


def of(spark, texts, *args, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", split_recursively(F.col("t"), *args, **kw).alias("c")).orderBy("i").collect()
    return [r.c and [(x.text, x.n) for x in r.c] if r.c is not None else None for r in rows]


def test_levels_by_hand(spark):
    """Each level is used only for what the level before left too long."""
    case = [
        "a b\n\nc d\n\ne f",  # paragraphs
        "a b\nc d\n\ne",  # a paragraph within the budget keeps its lines
        "a b c. d e. f",  # sentences
        "a b c d e f g",  # words
        "abcdefghij" * 20,  # nothing to cut at
        "", None, " \n\n ",
    ]
    assert of(spark, case, 4, 0) == [
        [("a b\n\nc d", 4), ("e f", 2)],
        [("a b\nc d", 4), ("e", 1)],
        [("a b c.", 3), ("d e. f", 3)],
        [("a b c d", 4), ("e f g", 3)],
        [("abcdefghij" * 20, 1)],
        [], None, [],
    ]


def test_overlap_by_hand(spark):
    assert of(spark, ["a b c d e f g h"], 4, 2) == [[("a b c d", 4), ("c d e f", 4), ("e f g h", 4)]]
    # whole parts only: a line of three tokens does not fit an overlap of two
    assert of(spark, ["a b c\nd e f\ng"], 4, 2) == [[("a b c", 3), ("d e f\ng", 4)]]
    # the new part leaves no room for the overlap
    assert of(spark, ["a\nb\nc d e"], 3, 1) == [[("a\nb", 2), ("c d e", 3)]]
    assert of(spark, ["a\nb\nc d"], 3, 1) == [[("a\nb", 2), ("b\nc d", 3)]]


@pytest.mark.parametrize("most, overlap", [(5, 0), (5, 3), (12, 4), (3, 3)])
def test_against_plain_loops(spark, most, overlap):
    rng = random.Random(most)
    texts = ["".join(rng.choices(["a", "bc", "d.", " ", " ", "\n", "\n\n", ". ", "\t", "\xa0"], k=rng.randint(0, 80))) for _ in range(150)]
    assert of(spark, texts, most, overlap) == [chunks(t, most, overlap, SEPARATORS) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", parts_of(F.col("t"), most).alias("p")).collect():
        assert "".join(p.text for p in r.p) == r.t


def test_other_separators(spark):
    texts = ["a|b|c[d[e f"]
    assert of(spark, texts, 1, 0, ("|", "[", " ")) == [chunks(texts[0], 1, 0, ("|", "[", " "))]


def test_chunk_rows(spark):
    body = "\n".join(f"line {i} " + "w " * 20 for i in range(60))
    documents = spark.createDataFrame([("u", "T", body), ("v", None, "few words"), ("w", None, None)], "url string, page_title string, content string")
    rows = chunk_recursively(documents).orderBy("chunk_ix").collect()
    assert [r.url for r in rows] == ["u"] * len(rows) and [r.chunk_ix for r in rows] == list(range(len(rows)))
    assert [(r.text, r.n_tokens) for r in rows] == chunks(body, 500, 50, SEPARATORS) and len(rows) > 2
