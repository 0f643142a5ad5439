"""Every registered query against its DuckDB counterpart, or for its rows alone."""

import re

import pytest

import __spark_entry__ as contract
from testbed.compare import connect, difference

SF = "/root/testdata/sf0.001"

def not_llm(names):
    """The queries of the optional subpackage have tests of their own, in tests/llm."""
    return sorted(n for n in names if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", not_llm(contract.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    mine = contract.queries()[name](spark, SF).toPandas()
    assert difference(mine, duck.execute(contract.oracle_sql()[name]).fetchdf()) is None


def test_every_query_has_a_counterpart():
    assert not_llm(contract.queries()) == not_llm(contract.oracle_sql())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == [
        "target_id", "stops", "compounds", "stint_laps", "predicted_total_time_sec", "rank",
    ]
