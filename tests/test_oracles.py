"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, con, name):
    fn, sql = QUERIES[name], SQLS[name]
    ok, note = compare(spark, con, SF_DIR, fn, sql)
    # An empty table on both sides agrees too.
    assert ok or note == "rows=0", note


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
