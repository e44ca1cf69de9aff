"""Bloom filters prune the rides before a join's shuffle, and change no result."""

import pytest

from ridelens.plans.registry import QUERIES
from ridelens.session import SESSION_DEFAULTS
from tests.conftest import canon

SF = "/root/testdata/sf0.01"       # more reviews than the sample has

PREFIX = "spark.sql.optimizer.runtime.bloomFilter."


@pytest.fixture
def firing(spark):
    """The session's defaults with no least size for a scan, and no broadcast joins, as large
    tables have it."""
    told = {k: v for k, v in SESSION_DEFAULTS.items() if k.startswith(PREFIX)}
    assert set(told) == {PREFIX + k for k in ("enabled", "applicationSideScanSizeThreshold", "creationSideThreshold")}
    told |= {PREFIX + "applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", ["rides_paid", "review_sample"])
def test_rides_are_filtered_before_their_shuffle(spark, firing, key):
    found = QUERIES[key](spark, SF)
    plan = optimized(found)
    assert "might_contain" in plan
    rows = found.collect()
    spark.conf.set(PREFIX + "enabled", "false")
    plain = QUERIES[key](spark, SF)
    assert "might_contain" not in optimized(plain)
    assert canon(rows) == canon(plain.collect())
