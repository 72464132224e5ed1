"""Every registered query against the same result in DuckDB."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in contract.queries().items() if name not in contract.LLM_QUERIES}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name not in contract.LLM_QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_its_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF) is None


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
