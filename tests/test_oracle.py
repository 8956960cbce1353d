"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
