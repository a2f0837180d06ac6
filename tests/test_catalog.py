"""Every registered query with SQL against DuckDB on the smallest driver tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    assert check(con, entry.queries()[name](spark, sf), SQL[name]) in (None, "EMPTY")


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 4
