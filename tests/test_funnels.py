"""Funnel goldens on hand-made tables (traps T2, T3, T4 of SURVEY §2.15)."""

from ridelens.operators import funnel
from tests.conftest import SCHEMAS


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_user_funnel_golden(small_world):
    got = rows(funnel.user_funnel(small_world))
    assert [r[:2] for r in got] == [
        ("app_downloads", 5), ("signups", 4), ("ride_requested", 5), ("ride_accepted", 4),
        ("ride_completed", 3), ("approved_transaction", 2), ("reviewed", 3)]
    assert [r[2] for r in got] == [None, 4 / 5, 5 / 4, 4 / 5, 3 / 4, 2 / 3, 3 / 2]
    # Lag 6 over seven rows reaches back only from the last row
    assert [r[3] for r in got] == [None] * 6 + [3 / 5]


def test_ride_funnel_golden(small_world):
    got = rows(funnel.ride_funnel(small_world))
    assert [r[:2] for r in got] == [
        ("app_downloads", None), ("signups", None), ("ride_requested", 6), ("ride_accepted", 5),
        ("ride_completed", 3), ("approved_transaction", 3), ("reviewed", 3)]
    # Step 3 divides by the NULL of step 2; lag 4 hits NULL rows for steps 5-6
    assert [r[2] for r in got] == [None, None, None, 5 / 6, 3 / 5, 1.0, 1.0]
    assert [r[3] for r in got] == [None] * 6 + [0.5]


def test_empty_source_drops_ride_row_but_keeps_user_row(spark, small_world):
    # The constant-row branch vanishes for an empty table, shifting the lags
    t = dict(small_world, app_downloads=spark.createDataFrame([], SCHEMAS["app_downloads"]))
    ride = rows(funnel.ride_funnel(t))
    assert [r[0] for r in ride] == ["signups", "ride_requested", "ride_accepted",
                                    "ride_completed", "approved_transaction", "reviewed"]
    assert ride[-1][3] == 0.5          # lag 4 now lands on ride_requested (6)
    assert ride[-2][3] is None         # ... and on signups (NULL) one row earlier
    user = rows(funnel.user_funnel(t))
    assert user[0][:2] == ("app_downloads", 0)
    # T4: zero denominator gives NULL instead of an error or infinity
    assert user[1][2] is None
    assert user[6][3] is None


def test_stage_conversion(small_world):
    got = {r.metric: (r.numerator, r.denominator, r.ratio)
           for r in funnel.stage_conversion(small_world).collect()}
    assert got == {"users_completed_after_accept": (3, 4, 0.75),
                   "rides_accepted_of_requested": (5, 6, 5 / 6)}


def test_funnel_ratios_keep_step(small_world):
    counts = funnel.funnel_counts(funnel.user_funnel_steps(small_world))
    got = funnel.funnel_ratios(counts, 6, "user_count").orderBy("step")
    assert got.columns == ["step", "funnel_name", "user_count", "perc_previous", "perc_top"]
    assert [r.step for r in got.collect()] == list(range(1, 8))


def test_shared_pass_equals_separate_counts(small_world):
    from pyspark.sql import functions as F
    rides = small_world["ride_requests"]
    fused = funnel.funnel_counts([
        funnel.FunnelStep("a", rides, "user_id"),
        funnel.FunnelStep("b", rides, "user_id", F.col("accept_ts").isNotNull()),
        funnel.FunnelStep("c", rides, "user_id", F.col("pickup_ts").isNotNull())])
    separate = funnel.funnel_counts([
        funnel.FunnelStep("a", rides, "user_id"),
        funnel.FunnelStep("b", rides.where(F.col("accept_ts").isNotNull()), "user_id"),
        funnel.FunnelStep("c", rides.where(F.col("pickup_ts").isNotNull()), "user_id")])
    assert sorted(fused.collect()) == sorted(separate.collect()) == [(1, "a", 5), (2, "b", 4),
                                                                    (3, "c", 3)]
    empty = rides.limit(0)
    got = funnel.funnel_counts([funnel.FunnelStep("a", empty, "user_id"),
                                funnel.FunnelStep("b", empty, "user_id", F.lit(True))])
    assert sorted(got.collect()) == [(1, "a", 0), (2, "b", 0)]


def test_shared_pass_matches_python_on_random_rides(spark):
    import random

    from pyspark.sql import functions as F
    rng = random.Random(7)
    rows = []
    for ride in range(3000):
        user = None if rng.random() < 0.05 else (1 if rng.random() < 0.3 else rng.randint(2, 400))
        rows.append((ride, user, rng.random() < 0.6, rng.random() < 0.4))
    rides = spark.createDataFrame(rows, "ride_id BIGINT, user_id BIGINT, a BOOLEAN, d BOOLEAN")
    got = funnel.funnel_counts([
        funnel.FunnelStep("requested", rides, "user_id"),
        funnel.FunnelStep("accepted", rides, "user_id", F.col("a")),
        funnel.FunnelStep("completed", rides, "user_id", F.col("a") & F.col("d"))])
    want = [len({u for _, u, a, d in rows if u is not None and cond(a, d)})
            for cond in (lambda a, d: True, lambda a, d: a, lambda a, d: a and d)]
    assert [r["count"] for r in got.orderBy("step").collect()] == want
