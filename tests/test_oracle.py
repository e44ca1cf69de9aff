"""Every registered query equals its DuckDB text on the driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from ridelens.plans.oracle import oracle_sql  # noqa: E402
from ridelens.plans.registry import QUERIES  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) >= 58
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_duckdb(spark, con, key):
    assert compare(spark, con, key, QUERIES[key], ORACLE[key], SF_SMALL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r.funnel_name for r in rows] == [
        "app_downloads", "signups", "ride_requested", "ride_accepted", "ride_completed",
        "approved_transaction", "reviewed"]
    assert df.columns == ["funnel_name", "user_count", "perc_previous", "perc_top"]
