import numpy as np
import pytest

from lectern.operators import ivf, search
from lectern.session import materialise


def table(spark, vectors, key):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} long, embedding array<float>")


def planted(rng, n, groups, dim=16):
    """Items around many directions, and questions that each lie beside four of them."""
    items = rng.normal(size=(groups, dim))[rng.integers(groups, size=n)] + 0.5 * rng.normal(size=(n, dim))
    asked = rng.normal(size=(60, dim))
    for q, vector in enumerate(asked):
        items[4 * q : 4 * q + 4] = vector + 0.15 * rng.normal(size=(4, dim))
    return items, asked


@pytest.fixture(scope="module")
def case(spark):
    items, asked = planted(np.random.default_rng(3), 4000, 80)
    items = materialise(table(spark, items, "vec_id"), "items")
    return items, materialise(table(spark, asked, "query_id"), "asked")


def test_planted_neighbours_are_found_in_few_cells(spark, case):
    items, asked = case
    quantiser = ivf.fit(items, "vec_id", cells=64, parts=4, codes=32)
    inverted = ivf.build(items, quantiser, "vec_id")
    assert inverted.count() == 4000  # each item is stored once
    found = ivf.topk_ivf(asked, items, inverted, quantiser, 4, n_probes=8, size=16, iid="vec_id")
    exact = search.topk_vector(asked, items, 4, iid="vec_id")
    planted_ones = {(q, 4 * q + j) for q in range(60) for j in range(4)}
    assert len(planted_ones & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * 240
    assert search.recall(found, exact, iid="vec_id").first().recall >= 0.9
    cost = ivf.ivf_cost(asked, inverted, quantiser, 8, 16).first()
    assert cost.n_scored < 0.25 * cost.n_questions * cost.n_items and cost.n_exact == 60 * 16


def test_all_cells_and_a_long_list_are_exact(spark, case, monkeypatch):
    items, asked = case
    monkeypatch.setattr(ivf, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(ivf, "ITEM_BLOCK", 50)
    quantiser = ivf.fit(items.limit(500), "vec_id", cells=8, parts=4, codes=4, rounds=2)
    some = materialise(items.where("vec_id < 600"), "some")
    inverted = ivf.build(some, quantiser, "vec_id")
    found = ivf.topk_ivf(asked, some, inverted, quantiser, 3, n_probes=8, size=600, iid="vec_id")
    assert sorted(found.collect()) == sorted(search.topk_vector(asked, some, 3, iid="vec_id").collect())


def test_codes_score_as_reconstructed_vectors(spark, case):
    items, asked = case
    quantiser = ivf.fit(items.where("vec_id < 300"), "vec_id", cells=4, parts=8, codes=16, rounds=2)
    rows = ivf.build(items.where("vec_id < 300"), quantiser, "vec_id").collect()
    made = {
        r.vec_id: quantiser.centres[r._cell] + np.concatenate([quantiser.words[m, c] for m, c in enumerate(r._codes)]) for r in rows
    }
    unit = {r.query_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in asked.collect()}
    inverted = ivf.build(items.where("vec_id < 300"), quantiser, "vec_id")
    for r in ivf.shortlist(asked, inverted, quantiser, 300, 4, iid="vec_id").collect():
        assert abs(r.score - unit[r.query_id] @ made[r.vec_id]) < 1e-5


def test_odd_vectors(spark):
    vectors = [[1, 0, 0, 0], None, [0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 1]]
    items, asked = table(spark, vectors, "vec_id"), table(spark, [[1, 0.1, 0, 0], None], "query_id")
    quantiser = ivf.fit(items, "vec_id", cells=3, parts=2, codes=3)
    found = ivf.topk_ivf(asked, items, ivf.build(items, quantiser, "vec_id"), quantiser, 2, iid="vec_id")
    assert [(r.query_id, r.vec_id, r.rk) for r in found.collect()] == [(0, 0, 1), (0, 3, 2)]
    empty = items.where("vec_id < 0")
    assert ivf.topk_ivf(asked, empty, ivf.build(empty, quantiser, "vec_id"), quantiser, 2, iid="vec_id").count() == 0
    with pytest.raises(ValueError):
        ivf.fit(items, "vec_id", cells=2, parts=3)
    with pytest.raises(ValueError):
        ivf.fit(empty, "vec_id", cells=2, parts=2)


def test_scores_held_at_once_change_nothing(monkeypatch):
    """A task held four million scores, in several copies."""
    assert ivf._TILE <= 500_000
    rng = np.random.default_rng(1)
    quantiser, unit = ivf.Quantiser(rng.normal(size=(2, 8)), rng.normal(size=(2, 4, 4))), rng.normal(size=(30, 8))
    listed = ivf._Shortlist(unit, quantiser, 1)
    codes, keys = rng.integers(4, size=(90, 2)), rng.permutation(90)
    whole = [set(zip(*(x.tolist() for x in listed.best(codes, keys, 5)), strict=True))]
    monkeypatch.setattr(ivf, "_TILE", 100)
    assert whole == [set(zip(*(x.tolist() for x in listed.best(codes, keys, 5)), strict=True))]
