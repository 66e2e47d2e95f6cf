"""Every registered query against its restatement in SQL, on the whole sf0.01 tables."""

import pytest

import __spark_entry__ as contract
from conftest import SF
from tools.compare import connect, differences

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert differences(spark, duck, SF, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["Time", "Lat", "Lon", "Pickup_Count"]
    assert len(df.columns) == 4 + 12 + 4 + 4 * 10 + 7  # ten stations in the smallest tables
