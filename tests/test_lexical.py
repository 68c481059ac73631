import math
import random
import re
from collections import Counter

import pytest

from lectern.operators import lexical


def scan(chunks, questions, k):
    """BM25 of every chunk for every question."""
    said = {c: re.findall("[a-z0-9]+", (t or "").lower()) for c, t in chunks}
    said = {c: w for c, w in said.items() if w}
    mean = sum(map(len, said.values())) / len(said)
    df = Counter(w for ws in said.values() for w in set(ws))
    out = []
    for q, text in questions:
        scored = []
        for c, ws in said.items():
            n, score = Counter(ws), 0.0
            for w in set(re.findall("[a-z0-9]+", (text or "").lower())) & set(ws):
                idf = math.log(1 + (len(said) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if score:
                scored.append((-round(score, 6), c))
        out += [(q, c, -s, rk) for rk, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def case(seed):
    """Words of very different frequency, lengths from one word to hundreds, and equal chunks."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    chunks = [(f"c{i:04d}", " ".join(rng.choices(vocabulary, weights, k=int(rng.lognormvariate(3, 1)) + 1))) for i in range(1500)]
    chunks += [("same1", "w1 w7 w7"), ("same2", "w1 w7 w7"), ("none", "--"), ("null", None), ("Caps", "W300, w301!")]
    questions = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 6)))) for i in range(40)]
    return chunks, questions + [(90, "unknown words"), (91, ""), (92, None), (93, "w300 W300 w301"), (94, " ".join(vocabulary))]


@pytest.mark.parametrize("k, size, seeds", [(4, 32, 1), (1, 512, 2), (30, 16, 3)])
def test_skipping_blocks_changes_nothing(spark, k, size, seeds):
    chunks, questions = case(k)
    index = lexical.build_lexical(spark.createDataFrame(chunks, "chunk_id string, text string"), range_size=size)
    asked = spark.createDataFrame(questions, "query_id int, text string")
    found = sorted(map(tuple, lexical.topk_lexical(asked, index, k, seeds=seeds).collect()))
    want = scan(chunks, questions, k)
    assert [(q, c, rk) for q, c, _, rk in found] == [(q, c, rk) for q, c, _, rk in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(found, want, strict=True))


def test_blocks_are_skipped(spark):
    chunks, questions = case(2)
    index = lexical.build_lexical(spark.createDataFrame(chunks, "chunk_id string, text string"), range_size=16)
    cost = lexical.lexical_cost(spark.createDataFrame(questions[:40], "query_id int, text string"), index, 2).first()
    assert 0 < cost.n_read < 0.75 * cost.n_blocks
    assert max(len(r.hits) for r in index.blocks.collect()) < 40  # no list grows with the data


def test_nothing_to_search(spark):
    empty = lexical.build_lexical(spark.createDataFrame([], "chunk_id string, text string"))
    asked = spark.createDataFrame([(1, "w1")], "query_id int, text string")
    assert lexical.topk_lexical(asked, empty).count() == 0
    assert tuple(lexical.lexical_cost(asked, empty).first()) == (0, 0)


def test_a_range_gives_each_question_its_best_chunks_only(spark):
    """Every pair of a question and a chunk that share a word was a row; and every posting was moved to its block."""
    chunks, questions = case(5)
    index = lexical.build_lexical(spark.createDataFrame(chunks, "chunk_id string, text string"), range_size=4096)
    asked = lexical._asked(spark.createDataFrame(questions, "query_id int, text string"), index, "query_id", "text")
    pairs = asked.select("qid").distinct().crossJoin(index.blocks.select("range").distinct())
    n = lexical._scored(pairs, asked, index, 2).count()
    assert 2 * asked.select("qid").distinct().count() <= n < 0.2 * sum(1 for _ in scan(chunks, questions, 10**6))
