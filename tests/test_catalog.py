"""Every board query against DuckDB on the smallest tables."""

import os

import oracle
import pytest

from tallyboard.plans import aspects, catalog, lanes, market, tick  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    mine, theirs = oracle.same_rows(catalog.QUERIES[name](spark, oracle.DATA), con.sql(catalog.ORACLE_SQL[name]))
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {*catalog.QUERIES} <= {*queries} and {*sql} <= {*queries}
    assert __spark_entry__.entry(spark).count() > 0
