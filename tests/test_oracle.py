"""Every query with a SQL twin agrees with DuckDB on the smallest tables."""

import pytest

import oracle as tool  # tests/oracle.py
from __spark_entry__ import entry, oracle_sql, queries

SF = "0.001"


@pytest.fixture(scope="module")
def duck():
    return tool.connect(SF)


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_matches_sql(spark, duck, key):
    got = queries()[key](spark, f"{tool.DATA}/sf{SF}").toPandas()
    assert tool.compare(got, duck.execute(oracle_sql()[key]).df()) == ""


def test_entry_counts_every_row(spark):
    out = entry(spark).toPandas().set_index(["kind", "name"])["n"]
    assert out["count", "total"] == out["count", "pass"] + out["count", "fail"] == out["reason"].sum()
    assert out["split"].sum() == out["count", "pass"]
