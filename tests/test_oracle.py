"""Each query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import connect, differences
from lectern.plans.catalog import QUERIES
from lectern.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    assert differences(spark, con, name, folder) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "result", "sources"]
    assert df.count() > 0
