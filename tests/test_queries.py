"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from hectare.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
REGISTRY = all_queries()
QUERIES, ORACLE = REGISTRY.QUERIES, REGISTRY.ORACLE


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = compare(spark, duck, QUERIES[name], ORACLE.get(name), FOLDER)
    assert result.startswith("ok") or (name not in ORACLE and result.startswith("ran")), result


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
