"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connection

import __spark_entry__ as entry
from flowmill.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DIR)


@pytest.mark.parametrize("name", list(registry.sql()))
def test_query_equals_sql(spark, con, name):
    diff, _ = compare(registry.queries()[name](spark, DIR), con, registry.sql()[name])
    assert diff == []


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.sql()])
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() >= 0


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and set(registry.queries()) <= set(q)
    assert entry.entry(spark).count() > 0
