"""Segmented extracts: fan-out, stage definitions, coalesce-after-group, minute
fields (traps T6-T11, T19)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ridelens.functions.time import minute_field
from ridelens.operators import segments
from tests.conftest import ts


def by_segment(df, *measures):
    return {(r.platform, r.age_range, r.year, r.month, r.hour): tuple(r[m] for m in measures)
            for r in df.collect()}


NS = "Not specified"


def test_completed_stage_counts_transaction_fanout(small_world):
    # T8 + T9: stage 5 means cancel_ts IS NULL; ride 100 has two transactions
    got = by_segment(segments.ux_completed(small_world), "user_count", "ride_count")
    assert got == {("ios", NS, 2021, 1, 8): (1, 2),
                   ("android", None, 2021, 1, 8): (1, 1),
                   ("web", "35-44", 2021, 2, 17): (1, 1),
                   (None, None, None, None, None): (1, 1)}


def test_payment_stage_keeps_orphan_transactions(small_world):
    got = by_segment(segments.ux_payment(small_world), "user_count", "ride_count")
    assert got == {("ios", NS, 2021, 1, 8): (1, 2),
                   # ride 105 (rider without signup) and orphan transaction 999
                   (None, None, None, None, None): (1, 1)}


def test_review_stage_segments_by_reviewer(small_world):
    # Age and platform come from the review's own user (user 40 for ride 777)
    got = by_segment(segments.ux_review(small_world), "user_count", "ride_count")
    assert got == {("ios", NS, 2021, 1, 8): (1, 2),
                   ("ios", "25-34", 2021, 2, 17): (1, 1),
                   (None, None, None, None, None): (1, 1)}


def test_user_extract_is_seven_stages_in_order(small_world):
    df = segments.user_extract(small_world)
    steps = [r.funnel_step for r in df.collect()]
    assert steps == sorted(steps) and set(steps) == set(range(1, 8))
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "int", "string", "string", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_paid_and_reviewed_ride_stages(small_world):
    paid = by_segment(segments.rx_paid(small_world), "ride_count", "sum_purchase_amount")
    assert paid == {("ios", NS, 2022, 5, 8): (1, Decimal("14.75")),
                    (None, NS, 2022, 6, 17): (1, Decimal("3.00"))}
    # Counts paid rides; mean rating over (transaction x review) rows
    rev = by_segment(segments.rx_reviewed(small_world), "ride_count", "avg_rating")
    assert rev == {("ios", NS, 2022, 5, 8): (1, 4.0),
                   (None, NS, 2022, 6, 17): (1, 1.0)}


def test_requested_stage_rounding_and_proportion(small_world):
    got = by_segment(segments.rx_requested(small_world), "ride_count",
                     "avg_time_ride_requested_cancelled", "proportion_of_cancellations")
    assert got[("web", "35-44", 2022, 5, 9)] == (1, 4.0, 1.0)      # 4.5 min -> field 4
    assert got[("ios", "25-34", 2022, 6, 16)] == (1, 5.0, 1.0)     # 24h5m -> field 5
    assert got[("web", "35-44", 2022, 6, 16)] == (1, None, 0.0)


def test_minute_field_semantics(spark):
    # The minute field of the interval, with sign - not elapsed minutes
    df = spark.createDataFrame(
        [(ts(2022, 1, 1, 0, 0), ts(2022, 1, 1, 1, 15)),
         (ts(2022, 1, 1, 0, 0), ts(2022, 1, 2, 0, 5)),
         (ts(2022, 1, 1, 0, 10), ts(2022, 1, 1, 0, 4, 30)),
         (ts(2022, 1, 1, 0, 0), None)],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    got = [r[0] for r in df.select(minute_field("b", "a")).collect()]
    assert got == [15, 5, -5, None]


def test_null_and_literal_not_specified_merge_only_when_equal(make_tables):
    # NULL age and a stored 'Not specified' group separately, print alike,
    # and UNION merges the two rows when every measure agrees
    T = ts
    ride = lambda rid, uid: (rid, uid, T(2022, 1, 1, 8), T(2022, 1, 1, 8, 5),
                             T(2022, 1, 1, 8, 20), T(2022, 1, 1, 9), None)
    t = make_tables(
        app_downloads=[(1, "ios", T(2021, 1, 1)), (2, "ios", T(2021, 1, 1))],
        signups=[(10, 1, NS), (20, 2, None)],
        ride_requests=[ride(100, 10), ride(101, 20)])
    step5 = segments.rx_completed(t)
    assert step5.count() == 2
    extract = segments.ride_extract(t).where(F.col("funnel_step") == 5)
    assert extract.count() == 1
    # with different measures both rows survive
    t2 = dict(t, ride_requests=t["ride_requests"].union(
        t["ride_requests"].limit(1).withColumn("ride_id", F.lit(102).cast("bigint"))
        .withColumn("dropoff_ts", F.lit(dt.datetime(2022, 1, 1, 10, 7)).cast("timestamp_ntz"))))
    assert segments.ride_extract(t2).where(F.col("funnel_step") == 5).count() == 2


def test_ride_extract_schema(small_world):
    df = segments.ride_extract(small_world)
    assert df.schema.simpleString() == (
        "struct<funnel_step:int,funnel_name:string,ride_count:bigint,platform:string,"
        "age_range:string,year:bigint,month:bigint,hour:bigint,"
        "avg_time_requested_pickup:double,avg_time_requested_accepted:double,"
        "avg_time_accepted_pickup:double,avg_time_ride_requested_cancelled:double,"
        "avg_time_accepted_cancelled:double,proportion_of_cancellations:double,"
        "avg_ride_duration:double,sum_purchase_amount:decimal(22,2),avg_rating:double>")


def test_fused_stages_equal_separate_stages(small_world):
    from tests.conftest import canon
    t = small_world
    fused = segments.ux_ride_stages(t)
    separate = segments.ux_requested(t).union(segments.ux_accepted(t)) \
        .union(segments.ux_completed(t)).union(segments.ux_payment(t))
    assert canon(fused.collect()) == canon(separate.collect())
    fused = segments.rx_ride_stages(t).union(segments.rx_paid_stages(t))
    separate = segments.rx_requested(t)
    for stage in segments.RIDE_STAGES[1:]:
        separate = separate.union(stage(t))
    assert canon(fused.collect()) == canon(separate.collect())


def test_segment_subsets(spark, small_world):
    from tests.conftest import canon
    t = small_world
    keys = ["platform", "year"]
    ux = segments.user_extract(t, keys)
    assert ux.columns == ["funnel_step", "funnel_name", "platform", "year", "user_count",
                          "ride_count"]
    separate = segments.ux_downloads(t, keys)
    for stage in segments.USER_STAGES[1:]:
        separate = separate.union(stage(t, keys))
    assert canon(ux.collect()) == canon(separate.collect())
    rx = segments.ride_extract(t, ["age_range", "hour"])
    separate = segments.rx_requested(t, ["age_range", "hour"])
    for stage in segments.RIDE_STAGES[1:]:
        separate = separate.union(stage(t, ["age_range", "hour"]))
    assert canon(rx.collect()) == canon(separate.distinct().collect())
    import pytest
    with pytest.raises(ValueError):
        segments.user_extract(t, ["platform", "weekday"])


def test_segment_subsets_against_duckdb(spark):
    import duckdb

    from tests.test_worlds import skewed_world
    w = skewed_world(spark)
    con = duckdb.connect()
    for name, df in w.items():
        con.register(name, df.toArrow())
    got = segments.ux_requested(w, ["platform", "year"]).collect()
    want = con.sql("""
        SELECT 3, 'ride_requested', a.platform, extract(year FROM a.download_ts),
               count(DISTINCT r.user_id), count(r.user_id)
        FROM ride_requests r LEFT JOIN signups s ON r.user_id = s.user_id
        LEFT JOIN app_downloads a ON s.session_id = a.app_download_key
        GROUP BY 3, 4""").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    got = segments.rx_accepted(w, ["age_range", "hour"]).select(
        "age_range", "hour", "ride_count", "avg_time_accepted_pickup").collect()
    want = con.sql("""
        SELECT COALESCE(s.age_range, 'Not specified'), extract(hour FROM r.request_ts),
               count(DISTINCT r.ride_id),
               CAST(sum(extract(minute FROM (r.pickup_ts - r.accept_ts))) AS DOUBLE)
                 / NULLIF(count(extract(minute FROM (r.pickup_ts - r.accept_ts))), 0)
        FROM ride_requests r LEFT JOIN signups s ON r.user_id = s.user_id
        WHERE r.accept_ts IS NOT NULL
        GROUP BY s.age_range, extract(hour FROM r.request_ts)""").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("keys", [["platform"], ["hour"], ["year", "platform"]])
@pytest.mark.parametrize("stage", segments.RIDE_STAGES)
def test_ride_stages_for_any_segments(spark, small_world, stage, keys):
    """Each single ride stage over a subset of the segments equals DuckDB on the same tables."""
    import duckdb
    con = duckdb.connect()
    for name, df in small_world.items():
        con.register(name, df.toArrow())
    paid = stage in (segments.rx_paid, segments.rx_reviewed)
    sql = {"platform": "a.platform", "hour": "extract(hour FROM r.request_ts)", "year": "extract(year FROM r.request_ts)"}
    where = {segments.rx_requested: "true", segments.rx_accepted: "r.accept_ts IS NOT NULL"}.get(
        stage, "r.accept_ts IS NOT NULL AND r.dropoff_ts IS NOT NULL")
    ordered = [k for k in segments.SEGMENT_KEYS if k in keys]
    want = con.sql(f"""
        SELECT {', '.join(sql[k] for k in ordered)}, count(DISTINCT r.ride_id)
        FROM ride_requests r LEFT JOIN signups s ON r.user_id = s.user_id
        LEFT JOIN app_downloads a ON s.session_id = a.app_download_key
        {"JOIN transactions t ON r.ride_id = t.ride_id AND t.charge_status = 'Approved'" if paid else ''}
        WHERE {where} GROUP BY {', '.join(sql[k] for k in ordered)}""").fetchall()
    got = stage(small_world, keys).select(*ordered, "ride_count").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and want
