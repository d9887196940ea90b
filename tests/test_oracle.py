"""Every SQL-expressible named query equals its independent DuckDB plan (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck

ORACLE = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_duckdb(spark, con, small_dir, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], small_dir)
    assert str(res["status"]).startswith("ok"), res


def test_every_query_has_a_callable_and_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["booking_channel", "bookings", "revenue", "avg_fare", "cancel_rate"]
    assert df.count() > 0
