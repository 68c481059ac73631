"""Queries against their SQL on the same tables; rows of those without SQL."""

import pytest

from check_oracle import connect, differences
from lectern.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, folder, name):
    assert differences(spark, con, name, folder) is None
