import random

import numpy as np
import pytest

from lectern.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id long, vector int, cluster int, score long"


def brute(data, anchor):
    import math

    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], y)
        for i, v, y in data
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, v, y) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for k, (j, w, z) in enumerate(kept) if k != at), key=lambda r: r[:2])
        for p, j, z in [r for r in scored if r[2] == y][:5]:
            hard = [(n, k) for n, k, x in scored if x != y and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(hard, 1)]
    return sorted(out)


def corpus(rng, n, dim=6, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    made = []
    for k in range(n):
        c = rng.choice(centres)
        made.append((k, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(labels)))
    made += [(n + k, made[3][1], k % labels) for k in range(60)]  # very many equal vectors
    return made


@pytest.mark.parametrize("block,group", [(8192, 1024), (32, 5)])
def test_against_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "GROUPS", 3)
    monkeypatch.setattr(negatives, "PER_CENTRE", 4)
    data = corpus(random.Random(block), 400)
    df = spark.createDataFrame([(i, v, y, *[None] * 5) for i, v, y in data], SCHEMA)
    found = sorted(map(tuple, negatives.mine(df, "id % 10 = 0").collect()))
    assert found == brute(data, lambda i: i % 10 == 0) and found


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [1.0, k / 100], k % 2) for k in range(30)]
    odd = [
        (100, None, 1), (101, [], 1), (102, [1.0, None], 1), (103, [nan, 1.0], 1), (104, [1.0, inf], 0),
        (105, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (106, [0.0, 0.0], 1), (0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (7, [-1.0, -2.0], 1),
    ]
    data = good + odd
    df = spark.createDataFrame([(i, v, y, *[None] * 5) for i, v, y in data], SCHEMA)
    assert sorted(map(tuple, negatives.mine(df, "id % 5 = 0").collect())) == brute(data, lambda i: i % 5 == 0)
    # vectors of another length take no part
    more = spark.createDataFrame([(200, [1.0], 1, *[None] * 5)], SCHEMA)
    assert negatives.mine(df.union(more), "id % 5 = 0").count() == negatives.mine(df, "id % 5 = 0").count()


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(1, [1.0], 1, *[None] * 5)], SCHEMA)
    assert negatives.mine(df, "id % 10 = 0").count() == 0
    assert negatives.mine(df.limit(0), "id % 10 = 0").count() == 0


def test_walk_ends_early():
    """The certificate leaves out most of a block whose vectors point elsewhere."""
    rng = np.random.default_rng(5)
    near, far = rng.normal((9, 0, 0), 0.1, (300, 3)), rng.normal((-9, 0, 0), 0.1, (20_000, 3))
    vectors, ids = np.rint(256 * np.concatenate([far, near])), np.arange(20_300)
    shared = negatives.SharedList(vectors[-4:], ids, vectors, np.zeros(20_300), ids)
    looked = []

    def allowed(alive, places, score):
        looked.append(score.size)
        return [score == score]

    anchor, wish, place, score = shared.best(allowed, np.full((4, 1), -np.inf), 5)
    exact = vectors[-4:] @ vectors.T
    for a in range(4):
        assert sorted(score[anchor == a], reverse=True) == sorted(exact[a], reverse=True)[:5]
    assert sum(looked) < 4 * 2000
