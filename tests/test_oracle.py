"""Every registered query against DuckDB on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    actual = oracle.spark_table(contract.queries()[name](spark, SF))
    assert actual == oracle.duckdb_table(connection, contract.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
