"""Every registered query against its check SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_check(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, CHECKS[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 32
