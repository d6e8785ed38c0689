"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
from basketry.catalog import ORACLES, QUERIES
from compare import database, difference


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["visit_number", "trip_type"] and df.count() > 0
