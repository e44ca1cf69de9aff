"""Tables bucketed by ride: the same results, without a shuffle by ride."""

import pytest

from ridelens.operators import segments
from ridelens.sources.bucketed import RIDE_KEYED, load_bucketed_tables, store_bucketed
from ridelens.sources.fixtures import fixture_tables
from ridelens.sources.tables import TABLE_NAMES
from tests.conftest import SF_SMALL, canon


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    tables = {n: fixture_tables(spark, SF_SMALL)[n] for n in TABLE_NAMES}
    store_bucketed(tables, 4, "bucket_test", str(tmp_path_factory.mktemp("buckets")))
    yield tables, load_bucketed_tables(spark, TABLE_NAMES, "bucket_test")
    for name in TABLE_NAMES:
        spark.sql(f"DROP TABLE bucket_test_{name}")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stage", [segments.rx_paid_stages, segments.ride_extract])
def test_same_rows(bucketed, stage):
    plain, stored = bucketed
    assert canon(stage(plain).collect()) == canon(stage(stored).collect())


def test_paid_stages_do_not_shuffle_by_ride(bucketed, no_broadcast):
    plain, stored = bucketed
    assert "hashpartitioning(ride_id" in executed(segments.rx_paid_stages(plain))
    plan = executed(segments.rx_paid_stages(stored))
    before_users = [line for line in plan.splitlines() if "hashpartitioning(ride_id" in line]
    # what is left by ride is the distinct count of the segments, after the users' join
    assert all("platform" in line for line in before_users), before_users
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan


def test_one_file_a_bucket(spark, bucketed):
    for name in RIDE_KEYED:
        assert len(spark.table(f"bucket_test_{name}").inputFiles()) <= 4
