"""LEFT JOINs with hot keys split by the plan: exact, and even over the tasks."""

import pytest
from pyspark.sql import functions as F

from ridelens.operators import joins
from ridelens.operators.skew import heavy_keys, split_left_join
from tests.conftest import canon
from tests.test_worlds import skewed_world


def plain(left, right):
    return left.join(right, F.col("k") == F.col("r"), "left").select("k", "a", "b")


@pytest.fixture
def sides(spark):
    """A third of the left rows hold key 1, a fifth NULL; the right has none, one or many
    rows for a key, a third of them for key 2, and NULL keys."""
    i = F.col("id")
    left = spark.range(3000).select(
        F.when(i % 3 == 0, 1).when(i % 5 == 0, F.lit(None)).otherwise(i % 400).alias("k"), i.alias("a"))
    right = spark.range(600).select(
        F.when(i % 3 == 0, 2).when(i % 7 == 0, F.lit(None)).otherwise(i % 350).alias("r"), i.alias("b"))
    return left, right


@pytest.mark.parametrize("on_left, on_right", [(False, False), (True, False), (False, True), (True, True)])
def test_equals_the_plain_join(sides, on_left, on_right):
    left, right = sides
    found = split_left_join(left, right, "k", "r", heavy_keys(left, "k") if on_left else None,
                            heavy_keys(right, "r") if on_right else None)
    assert found.columns == ["k", "a", "b"]
    assert canon(found.collect()) == canon(plain(left, right).collect())


def test_heavy_keys_are_few_and_all_found(sides):
    left, _ = sides
    rows = {r._heavy_key: r._copies for r in heavy_keys(left, "k", 8).collect()}
    counts = {r.k: r["count"] for r in left.where("k IS NOT NULL").groupBy("k").count().collect()}
    half = sum(counts.values()) / 16
    assert set(rows) == {k for k, n in counts.items() if n > half} and len(rows) <= 16
    assert all(n * half >= counts[k] for k, n in rows.items())
    assert heavy_keys(left.limit(0), "k").collect() == []


def sizes(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_ride_and_user_are_even_over_tasks(spark):
    """A ride with a third of the transactions and a user with a third of the rides: the
    largest task of the joins stays within three times the median."""
    t = skewed_world(spark, rides=6000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = t["transactions"].select(F.col("ride_id").alias("tx_ride_id"), "purchase_amount_usd")
        rides = t["ride_requests"].select("ride_id", "user_id")
        found = split_left_join(tx, rides, "tx_ride_id", "ride_id", heavy_keys(tx, "tx_ride_id"))
        plain_join = tx.join(rides, tx.tx_ride_id == rides.ride_id, "left")
        for df, even in ((found.where("tx_ride_id IS NOT NULL"), True), (plain_join, False)):
            spread = sorted(n for n in sizes(spark, df) if n)
            assert (spread[-1] <= 3 * spread[len(spread) // 2]) == even, spread
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_payment_users_equals_the_plain_joins(spark):
    t = skewed_world(spark)
    found = joins.payment_users(t["transactions"], t["ride_requests"], t["signups"], t["app_downloads"])
    users = joins.user_segments(t["signups"], t["app_downloads"])
    want = joins.approved(t["transactions"]).select(F.col("ride_id").alias("tx_ride_id"), "purchase_amount_usd") \
        .join(t["ride_requests"].select("ride_id", "user_id"), F.col("tx_ride_id") == F.col("ride_id"), "left") \
        .join(users, "user_id", "left")
    columns = ["tx_ride_id", "purchase_amount_usd", "user_id", "platform", "age_range"]
    assert canon(found.select(columns).collect()) == canon(want.select(columns).collect())


def test_no_heavy_key_leaves_a_plain_join(spark):
    """Without a heavy key the plan has one join and no salt; with one, its rows are found by
    a broadcast of the keys."""
    even = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.col("id").alias("r"), F.col("id").alias("b"))
    plan = split_left_join(even, right, "k", "r", heavy_keys(even, "k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    hot = even.select(F.when(F.col("k") % 2 == 0, 5).otherwise(F.col("k")).alias("k"), "a")
    found = split_left_join(hot, right, "k", "r", heavy_keys(hot, "k"))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
