"""Every query with a SQL twin must match DuckDB on the smallest driver tables (same comparison as the
correctness gate: columns, types, multiset of rows with doubles rounded to 6 digits)."""

import pytest

from tests.conftest import SMOKE_DIR

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

ORACLES = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def duck():
    from wavekit.plans.compare import duck_connect

    return duck_connect(SMOKE_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert {"wave", "prevalence", "its_fitted"} <= set(df.columns)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    from wavekit.plans.compare import compare

    ok, msg = compare(QUERIES[key](spark, SMOKE_DIR), duck, ORACLES[key])
    assert ok, msg
