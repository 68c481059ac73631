import numpy as np
import pytest
from test_ivf import planted, table

from lectern.operators import bounded, ivf, search
from lectern.session import materialise


@pytest.fixture(scope="module")
def case(spark):
    items, asked = planted(np.random.default_rng(8), 3000, 40, dim=6)
    return materialise(table(spark, items, "vec_id"), "items"), materialise(table(spark, asked, "query_id"), "asked")


@pytest.mark.parametrize("pivots", [1, 12])
def test_the_result_is_exact_for_any_pivots(spark, case, pivots):
    items, asked = case
    centres = np.random.default_rng(pivots).normal(size=(pivots, 6))
    blocks = bounded.block(items, centres / np.linalg.norm(centres, axis=1, keepdims=True), "vec_id")
    for k in (1, 5, 4000):
        found = bounded.topk_bounded(asked, blocks, k, iid="vec_id")
        exact = search.topk_vector(asked, items, k, iid="vec_id")
        assert sorted(found.collect()) == sorted(exact.collect())


def test_blocks_are_left_out(spark, case):
    items, asked = case
    blocks = bounded.block(items, ivf.fit(items, "vec_id", cells=40, parts=2, codes=1, rounds=4).centres, "vec_id")
    cost = bounded.bounded_cost(asked, blocks, 4, iid="vec_id").first()
    assert cost.n_pairs == 60 * 3000 and cost.n_scored < 0.4 * cost.n_pairs


def test_ties_and_odd_vectors(spark):
    items = table(spark, [[1, 0], [0, 1], None, [1, 0], [0, 0], [-1, 0]], "vec_id")
    asked = table(spark, [[2, 0], None, [0, 0]], "query_id")
    blocks = bounded.block(items, np.array([[0.6, 0.8]]), "vec_id")
    found = bounded.topk_bounded(asked, blocks, 2, iid="vec_id").where("query_id = 0").collect()
    assert sorted((r.vec_id, r.score, r.rk) for r in found) == [(0, 1.0, 1), (3, 1.0, 2)]
    empty = bounded.block(items.limit(0), np.array([[1.0, 0.0]]), "vec_id")
    assert bounded.topk_bounded(asked, empty, 2, iid="vec_id").count() == 0


def test_bounds_are_made_for_few_questions_at_a_time(spark, case, monkeypatch):
    """A task held the bounds of a whole batch of questions."""
    items, asked = case
    centres = np.random.default_rng(1).normal(size=(5, 6))
    blocks = bounded.block(items, centres / np.linalg.norm(centres, axis=1, keepdims=True), "vec_id")
    whole = sorted(bounded.topk_bounded(asked, blocks, 3, iid="vec_id").collect())
    made = []
    monkeypatch.setattr(bounded, "_CELLS", 4 * blocks.sizes.count())
    angles = bounded._angles
    monkeypatch.setattr(bounded, "_angles", lambda unit, pivots: angles(unit, pivots) if len(unit) <= 4 else made.append(len(unit)))
    assert sorted(bounded.topk_bounded(asked, blocks, 3, iid="vec_id").collect()) == whole
