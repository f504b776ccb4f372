"""Every catalogue query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert [d for d in differences(df, con, sql) if not d.startswith("note")] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
