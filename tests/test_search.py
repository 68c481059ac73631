import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding as E
from lectern.operators import search as S
from lectern.session import materialise


def brute(questions, items, k):
    def unit(m):
        m = np.array(m, dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    qn, iv = [q for q, _ in questions], [i for i, _ in items]
    scores = np.round(unit([v for _, v in questions]) @ unit([v for _, v in items]).T, 6)
    return {
        (qn[a], iv[b], rk + 1)
        for a in range(len(qn))
        for rk, b in enumerate(sorted(range(len(iv)), key=lambda b: (-scores[a, b], iv[b]))[:k])
    }


def vectors(spark, n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i:04d}", [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    # one vector repeated: a third of all rows are copies
    rows += [(f"b{i:04d}", rows[0][1]) for i in range(copies)]
    return rows


def found(df):
    return {(r.query_id, r.chunk_id, r.rk) for r in df.collect()}


@pytest.mark.parametrize("sent", [4096, 3])
def test_exact_equals_brute_force_with_many_copies(spark, monkeypatch, sent):
    monkeypatch.setattr(S, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(S, "ITEM_BLOCK", 50)
    monkeypatch.setattr(S, "_TILE_CELLS", 200)
    items = vectors(spark, 200, copies=100)
    asked = [(i, v) for i, (_, v) in enumerate(items[:20])]
    q = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    i = spark.createDataFrame(items, "chunk_id string, embedding array<float>").repartition(5)
    got = S.topk_vector(q, i, 4, sent_questions=sent)
    assert found(got) == brute(asked, items, 4)


def test_rank_has_no_gaps_and_scores_fall(spark, folder):
    em = spark.read.parquet(f"{folder}/embeddings.parquet")
    hits = S.topk_vector(em.select(F.col("vec_id").alias("query_id"), "embedding"), em, 5, iid="vec_id")
    by = {}
    for r in hits.collect():
        by.setdefault(r.query_id, {})[r.rk] = r.score
    assert len(by) == em.count()
    for ranks in by.values():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        assert [ranks[i] for i in range(1, 6)] == sorted(ranks.values(), reverse=True)


def test_fewer_items_than_k_and_missing_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    i = spark.createDataFrame(
        [("a", [1.0, 1.0]), ("b", None), ("z", [0.0, 0.0])], "chunk_id string, embedding array<float>"
    )
    for sent in (10, 0):
        assert found(S.topk_vector(q, i, 4, sent_questions=sent)) == {(1, "a", 1)}


def test_empty_sides(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    none = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    assert S.topk_vector(q, none, 4).count() == 0
    assert S.topk_vector(q, none, 4, sent_questions=0).count() == 0
    assert S.topk_vector(q.limit(0), none, 4).count() == 0
    assert S.topk_lsh(q, none, 4).count() == 0


def test_lsh_recall_on_given_vectors(spark, folder):
    em = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = em.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = S.topk_vector(q, em, 4, iid="vec_id")
    near = S.topk_lsh(q, em, 4, iid="vec_id", bits=2)
    assert S.recall(near, exact, iid="vec_id").first().recall >= 0.9


def test_lsh_scores_a_hot_bucket_whole(spark, monkeypatch):
    """With one cell for everything the result is exact, whatever the block sizes."""
    monkeypatch.setattr(S, "QUESTION_BLOCK", 5)
    monkeypatch.setattr(S, "ITEM_BLOCK", 30)
    items = vectors(spark, 100, seed=3, copies=60)
    asked = [(i, v) for i, (_, v) in enumerate(items[:12])]
    q = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    i = spark.createDataFrame(items, "chunk_id string, embedding array<float>")
    assert found(S.topk_lsh(q, i, 4, bits=0, tables=2)) == brute(asked, items, 4)


def test_lsh_finds_near_vectors_for_a_tenth_of_the_work(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1000, 64))
    near = base + 0.3 * rng.normal(size=(1000, 64))  # cosine 0.95 or so
    unit = [v / np.linalg.norm(v) for v in (*base, *near)]
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "vec_id int, embedding array<float>")
    asked = items.withColumnRenamed("vec_id", "query_id")
    pairs = {(r.query_id, r.vec_id) for r in S.topk_lsh(asked, items, 2, iid="vec_id").collect()}
    assert sum((i, i + 1000) in pairs for i in range(1000)) >= 0.95 * 1000
    cost = S.lsh_cost(asked, items, iid="vec_id").first()
    assert (cost.n_questions, cost.n_items) == (2000, 2000) and cost.n_scored <= 0.1 * 2000 * 2000
    empty = items.where("false")
    assert S.topk_lsh(asked, empty, 2, iid="vec_id").count() == 0
    assert S.lsh_cost(asked, empty, iid="vec_id").first().n_scored == 0


def reference_vector(text, dim=64):
    counts = [0] * dim
    for w in re.findall("[a-z0-9]+", text.lower()):
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    n = math.sqrt(sum(c * c for c in counts))
    return [c / n for c in counts] if n else None


def test_embedding(spark):
    texts = ["The cat, the CAT and 2 dogs", "x", "é ü", "", None, "a " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {r.query_id: r.embedding for r in E.embed(df, "text").collect()}
    assert set(got) == {0, 1, 5}
    for i, v in got.items():
        assert np.allclose(v, reference_vector(texts[i]), atol=1e-6)
        assert abs(sum(x * x for x in v) - 1) < 1e-5


@pytest.mark.parametrize("sent, hot", [(16_384, 100_000), (0, 100_000), (0, 8)])
def test_text_search_with_a_chunk_everyone_hits(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    monkeypatch.setattr(S, "SENT_HITS", sent)
    index = spark.createDataFrame(
        [("a", "u1", None, "visa forms and fees"), ("b", "u2", "T", "dogs and cats")],
        "chunk_id string, url string, page_title string, text string",
    )
    index = materialise(E.embed(index, "text"), "index")
    q = spark.createDataFrame([(i, "visa fees") for i in range(50)], "query_id int, text string")
    rows = S.topk_text(q, index, 1).collect()
    assert len(rows) == 50 and {r.chunk_id for r in rows} == {"a"}
    if sent:
        plan = S.topk_text(q, index, 1)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    docs = S.retrieve(q, index).first().docs
    assert [d.rk for d in docs] == [1, 2]


def test_result_rows(spark):
    df = spark.createDataFrame(
        [(1, ([("u", "t"), ("v", "s")],)), (2, (None,)), (3, None)],
        "query_id int, result struct<data_array: array<struct<url: string, text: string>>>",
    )
    assert [tuple(r) for r in S.result_rows(df).collect()] == [(1, 0, "u", "t"), (1, 1, "v", "s")]


@pytest.mark.parametrize("copies", [0, 300])
def test_few_items_are_scored_exactly_and_the_result_is_that_of_all(monkeypatch, copies):
    """Every score of a pair of blocks was ranked; only those that reach a probed one are."""
    monkeypatch.setattr(S, "_PROBED", 64)
    rng = np.random.default_rng(copies)
    items = np.concatenate([rng.normal(size=(2000, 8)), np.tile(rng.normal(size=8), (copies, 1)), np.full((3, 8), np.nan)])
    items, asked = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (items, np.concatenate([items[-310:-290], rng.normal(size=(30, 8))])))
    keys, best = rng.permutation(len(items)), S._Best(asked, 4)
    with monkeypatch.context() as m:
        if not copies:
            m.setattr(S._Best, "_all", None)  # nothing is ranked whole
        best.add(keys, items)
    scores = np.nan_to_num(np.rint(asked @ items.T * 1e6), nan=-1e9)
    for q in np.flatnonzero(~np.isnan(asked).any(axis=1)):
        want = sorted(zip(-scores[q], keys, strict=True))[:4]
        assert sorted(zip(-best.score[q], best.item[q], strict=True)) == want


def test_items_move_once_per_32768_questions_and_few_are_spread():
    assert S.QUESTION_BLOCK >= 32768 and S.LEAST_BLOCK <= S.ITEM_BLOCK
