"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    from tests.conftest import DATA

    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    assert compare(spark, con, folder, QUERIES[name], SQL.get(name)) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["alert_type", "n"] and df.count() > 0


def test_oracle_names_match():
    assert set(SQL) <= set(QUERIES)
