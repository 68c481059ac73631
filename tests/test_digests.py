import pytest

from lectern.operators import digests
from lectern.operators.index import snapshot_diff
from lectern.session import work_path

COLS = ["title", "body"]


def table(spark, rows):
    return spark.createDataFrame(rows, "url string, title string, body string")


def stored(spark, rows, **kw):
    path = work_path(spark, "snapshot")
    digests.write_snapshot(table(spark, rows), path, "url", COLS, **kw)
    return path


def diff(spark, a, b):
    found = digests.tree_diff(spark, a, b, "url", COLS)
    return sorted(map(tuple, found.changes.collect())), found


BASE = [(f"u{i}", "T" if i % 3 else None, f"body {i}") for i in range(400)]


def test_the_diff_is_that_of_whole_tables(spark):
    now = [r if r[0] != "u5" else ("u5", None, "other") for r in BASE if r[0] != "u9"] + [("new", "", "x"), ("u7", "T", "body 7")]
    got, found = diff(spark, stored(spark, BASE), stored(spark, now))
    want = snapshot_diff(table(spark, BASE), table(spark, now), "url", COLS)
    assert got == sorted(map(tuple, want.collect())) == [("new", "insert"), ("u5", "update"), ("u7", "update"), ("u9", "delete")]
    assert 0 < len(found.leaves) <= 4 and found.compared <= 1 + 16 + 4 * 16 and found.n_leaves == 256


def test_only_differing_leaves_are_read(spark):
    a = stored(spark, BASE)
    same, found = diff(spark, a, stored(spark, BASE[::-1]))
    assert same == [] and found.leaves == [] and found.compared == 1
    _, found = diff(spark, a, stored(spark, BASE + [("new", "", "x")]))
    plan = found.changes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(found.leaves) == 1


def test_null_and_repeated_keys_and_empty_snapshots(spark):
    rows = [(None, "a", "b"), ("x", "a", "b"), ("x", "a", "b")]
    a = stored(spark, rows, depth=1)
    assert diff(spark, a, stored(spark, rows[::-1], depth=1))[0] == []
    assert diff(spark, a, stored(spark, rows[:2], depth=1))[0] == [("x", "update")]
    empty = stored(spark, [], depth=1)
    assert diff(spark, empty, empty)[0] == []
    assert len(diff(spark, empty, stored(spark, rows[1:], depth=1))[0]) == 1
    with pytest.raises(ValueError):
        diff(spark, a, stored(spark, rows, depth=2))
