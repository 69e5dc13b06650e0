"""Every registered query against its DuckDB twin at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tools.oracle_check import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    ok, n, _dt, detail = compare(spark, con, name, E.queries()[name], SQL[name], SF01)
    assert ok, detail


def test_every_query_has_a_callable():
    assert set(SQL) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "Predicted_Concreteness" in df.columns
    assert all(1.0 <= r["Predicted_Concreteness"] <= 5.0 for r in rows)
