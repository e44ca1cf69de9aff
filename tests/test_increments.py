"""Partials of batches: merged they equal a full run, with late rows and reruns."""

import pytest
from pyspark.sql import functions as F

from ridelens.operators.increments import GRAINS, PartialStore
from tests.conftest import canon, ts
from tests.test_worlds import skewed_world


@pytest.fixture(scope="module")
def world(spark):
    return skewed_world(spark, rides=1500, users=120)


def batch(world, condition):
    return {**world, "ride_requests": world["ride_requests"].where(condition)}


@pytest.mark.parametrize("keys", [["platform", "age_range", "year", "month", "hour"], ["year", "month"], []])
def test_batches_with_late_rows_equal_a_full_run(spark, world, tmp_path, keys):
    """The second batch brings later days and a fifth of the earlier ones (late rides)."""
    late = F.pmod(F.col("ride_id"), F.lit(5)) == 0
    first = (F.col("ride_id") < 900) & ~late
    parts, whole = PartialStore(spark, f"{tmp_path}/parts"), PartialStore(spark, f"{tmp_path}/whole")
    parts.add("monday", batch(world, first))
    parts.add("tuesday", batch(world, ~first))
    whole.add("all", world)
    assert canon(parts.extract(keys).collect()) == canon(whole.extract(keys).collect())


def test_reruns_and_corrections_replace_a_batch(spark, world, tmp_path):
    store, whole = PartialStore(spark, f"{tmp_path}/parts"), PartialStore(spark, f"{tmp_path}/whole")
    store.add("a", batch(world, "ride_id < 700"))
    store.add("b", batch(world, "ride_id >= 700 AND ride_id < 750"))
    before = canon(store.extract(["platform"]).collect())
    store.add("b", batch(world, "ride_id >= 700 AND ride_id < 750"))
    assert canon(store.extract(["platform"]).collect()) == before
    store.add("b", batch(world, "ride_id >= 700"))         # the batch was incomplete
    whole.add("all", world)
    assert canon(store.extract(["platform"]).collect()) == canon(whole.extract(["platform"]).collect())


def test_partials_take_no_more_rows_and_bytes_than_the_rides(spark, make_tables, tmp_path):
    """Riders with far apart numbers on every day: a bitmap each would take 4 KB a stage."""
    rides = [(i, i * 7919 % 40_000, ts(2022, 1, 1 + i % 28, i % 24), None, None, None, None) for i in range(40_000)]
    t = make_tables(app_downloads=[(1, "ios", ts(2021, 1, 1))], signups=[(5, 1, "25-34")], ride_requests=rides)
    store = PartialStore(spark, f"{tmp_path}/store")
    store.add("a", t)
    files = [f for name in GRAINS for f in (tmp_path / "store").glob(f"{name}*/batch=a/*.parquet")]
    assert files
    kept = [spark.read.parquet(str(f)) for f in files]
    assert sum(k.count() for k in kept) <= 2 * len(rides)
    maps = [k.agg(F.sum(F.octet_length(c))).first()[0] or 0 for k in kept for c, kind in k.dtypes if kind == "binary"]
    assert sum(maps) <= 20 * len(rides)
    row = store.extract([]).collect()[0]
    assert (row.users_requested, row.rides_requested, row.rides_accepted) == (40_000, 40_000, 0)


def test_unknown_segment_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown segment"):
        PartialStore(spark, str(tmp_path)).extract(["colour"])
