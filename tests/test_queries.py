"""Every registered query against its SQL, whole results."""

import pytest
from compare import connect, difference
from conftest import SF_DIR

import __spark_entry__ as registry


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    result = registry.queries()[name](spark, SF_DIR)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert difference(result, con, sql) is None


def test_entry_runs(spark):
    assert registry.entry(spark).columns == ["doc_id", "dim", "value"]


def test_queries_and_sql_share_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
