"""Segmented funnel extracts at user and ride grain (the BI extracts).

Segments are platform, age group and calendar year/month/hour. Wide tables
(transactions, reviews, rides used only for their multiplicity) are
pre-aggregated per ride before they are joined, so shuffles carry one row per
ride and fan-out is applied as a weight; user-grain stages sum the rides per
user before the user dimension is joined, so a hot user collapses map-side.
Stages reading the same rows share one pass (``ux_ride_stages``,
``rx_ride_stages``, ``rx_paid_stages``); the single-stage functions remain
for callers that need one stage. All counts stay exact: ``count(col)`` over
fanned-out rows equals the sum of the per-row multiplicities,
``count(DISTINCT col)`` ignores them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelens.functions.numeric import ratio, ratio_sql, round_mean_half_up, round_mean_sql
from ridelens.functions.text import sql_name, sql_string
from ridelens.functions.time import minute_field, minute_field_sql, time_parts_sql
from ridelens.operators.joins import (approved_per_ride, transaction_multiplicity,
                                      transactions_per_ride, user_segments)
from ridelens.operators.setops import align, union_all

SEGMENT_KEYS = ["platform", "age_range", "year", "month", "hour"]
NOT_SPECIFIED = "Not specified"

USER_EXTRACT_SCHEMA = (
    "funnel_step INT, funnel_name STRING, platform STRING, age_range STRING, "
    "year BIGINT, month BIGINT, hour BIGINT, user_count BIGINT, ride_count BIGINT")

RIDE_EXTRACT_SCHEMA = (
    "funnel_step INT, funnel_name STRING, ride_count BIGINT, platform STRING, "
    "age_range STRING, year BIGINT, month BIGINT, hour BIGINT, "
    "avg_time_requested_pickup DOUBLE, avg_time_requested_accepted DOUBLE, "
    "avg_time_accepted_pickup DOUBLE, avg_time_ride_requested_cancelled DOUBLE, "
    "avg_time_accepted_cancelled DOUBLE, proportion_of_cancellations DOUBLE, "
    "avg_ride_duration DOUBLE, sum_purchase_amount DECIMAL(22,2), avg_rating DOUBLE")


def check_keys(keys: Sequence[str]) -> Sequence[str]:
    """Segment columns must be a subset of ``SEGMENT_KEYS``."""
    unknown = set(keys) - set(SEGMENT_KEYS)
    if unknown:
        raise ValueError(f"unknown segment columns {sorted(unknown)}; use {SEGMENT_KEYS}")
    return keys


def extract_schema(schema: str, keys: Sequence[str]) -> str:
    """The extract schema with only the chosen segment columns (in order)."""
    check_keys(keys)
    fields = StructType.fromDDL(schema).fields
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields
                     if f.name not in SEGMENT_KEYS or f.name in keys)


def _tag(step: int, name: str) -> list[Column]:
    return [F.lit(step).alias("funnel_step"), F.lit(name).alias("funnel_name")]


def _segmented(df: DataFrame, ts: str) -> DataFrame:
    """Add the calendar parts of ``ts`` next to the other columns."""
    return df.selectExpr("*", *time_parts_sql(ts))


# ---------------------------------------------------------------- user grain

def _dimension_stage(step: int, name: str, df: DataFrame, key: str,
                     keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 1-2 (user-level tables): ``count(DISTINCT key)`` per segment."""
    out = df.groupBy(*keys).agg(F.countDistinct(key).cast("bigint").alias("user_count"))
    return align(out.select(*_tag(step, name), "*"), extract_schema(USER_EXTRACT_SCHEMA, keys))


def per_user_segments(rows: DataFrame, t: Mapping[str, DataFrame],
                      measures: dict[str, Column],
                      keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Ride-level ``rows`` (with ``user_id``) summed per user *before* the
    user dimension is joined: the map-side combine collapses a user holding a
    third of all rides, so the join sees one row per user on each side. The
    joined rows are summed again per (segment, user) - co-partitioned with
    the join on user_id, no extra shuffle - which keeps the counts exact if
    the dimension holds several rows for one user."""
    per_user = rows.groupBy("user_id").agg(*[m.alias(k) for k, m in measures.items()])
    joined = _rides_by_user(per_user, t)
    return joined.groupBy(*keys, "user_id").agg(*[F.sum(k).alias(k) for k in measures])


def _user_stage(step: int, name: str, rows: DataFrame, t: Mapping[str, DataFrame],
                weight: str | None = None, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 3-7: per segment ``count(DISTINCT user_id)`` and ``count(user_id)``
    over ride-level rows, each row standing for ``weight`` joined rows."""
    w = F.col(weight) if weight else F.lit(1)
    per = per_user_segments(rows, t, {"_n": F.count(F.lit(1)), "_w": F.sum(w)}, keys)
    known = F.col("user_id").isNotNull()
    out = per.groupBy(*keys).agg(
        F.sum(F.when(known, 1).otherwise(0)).cast("bigint").alias("user_count"),
        F.sum(F.when(known, F.col("_w")).otherwise(0)).cast("bigint").alias("ride_count"))
    return align(out.select(*_tag(step, name), "*"), extract_schema(USER_EXTRACT_SCHEMA, keys))


def ux_downloads(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 1: downloads LEFT JOIN signups, by download time."""
    s = t["signups"].select("session_id", "age_range")
    a = t["app_downloads"]
    df = a.join(s, a.app_download_key == s.session_id, "left")
    return _dimension_stage(1, "downloads", _segmented(df, "download_ts"), "app_download_key", keys)


def ux_signups(t: Mapping[str, DataFrame],
               keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 2: signups LEFT JOIN downloads."""
    df = user_segments(t["signups"], t["app_downloads"])
    return _dimension_stage(2, "signups", _segmented(df, "download_ts"), "user_id", keys)


def _rides_by_user(rides: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    return _segmented(rides.join(user_segments(t["signups"], t["app_downloads"]),
                                 "user_id", "left"), "download_ts")


def ux_requested(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    rides = t["ride_requests"].select("user_id")
    return _user_stage(3, "ride_requested", rides, t, keys=keys)


def ux_accepted(t: Mapping[str, DataFrame],
                keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    rides = t["ride_requests"].where(F.col("accept_ts").isNotNull()).select("user_id")
    return _user_stage(4, "ride_accepted", rides, t, keys=keys)


def ux_completed(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 5: rides LEFT JOIN transactions (multiplicity only) WHERE
    cancel_ts IS NULL; each ride weighs max(1, its transaction rows)."""
    rides = t["ride_requests"].where(F.col("cancel_ts").isNull()).select("ride_id", "user_id")
    mult = transaction_multiplicity(t["transactions"])
    weighted = rides.join(mult, "ride_id", "left") \
        .select("user_id", F.coalesce(F.col("n_tx"), F.lit(1)).alias("w"))
    return _user_stage(5, "ride_completed", weighted, t, "w", keys)


def ux_payment(t: Mapping[str, DataFrame],
               keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 6: approved transactions (per ride) LEFT JOIN rides; orphan
    transactions land in the all-NULL segment with zero counts."""
    paid = approved_per_ride(t["transactions"]).select("ride_id", "n_tx")
    rides = t["ride_requests"].select("ride_id", "user_id")
    df = paid.join(rides, "ride_id", "left").select("user_id", "n_tx")
    return _user_stage(6, "payment", df, t, "n_tx", keys)


def ux_review(t: Mapping[str, DataFrame],
              keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 7: reviews LEFT JOIN rides (multiplicity only), segments through
    the review's own user."""
    # The join stays a plain one (ride ids only): both inputs are shuffles, so
    # AQE can split a ride id that holds a third of the reviews; the rows are
    # then summed per user before the user dimension is joined.
    re = t["reviews"].select("ride_id", "user_id") \
        .join(t["ride_requests"].select("ride_id"), "ride_id", "left").select("user_id")
    return _user_stage(7, "review", re, t, keys=keys)


USER_STAGES = [ux_downloads, ux_signups, ux_requested, ux_accepted, ux_completed,
               ux_payment, ux_review]


def _stacked(grouped: DataFrame, stages: list[tuple[int, str, str, dict[str, str]]],
             schema: str, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """One output row per (segment, stage) for the stages the segment has rows
    in: ``stages`` holds (number, name, row-count column, output columns as SQL
    by name); every stage row carries the full schema, absent columns NULL."""
    fields = [f for f in StructType.fromDDL(schema).fields if f.name not in SEGMENT_KEYS]
    values, structs = [], []
    for i, (step, name, present, cols) in enumerate(stages):
        given = {"funnel_step": str(step), "funnel_name": sql_string(name)}
        for field, col in cols.items():
            values.append(f"{col} AS {sql_name(f'_v{i}_{field}')}")
            given[field] = sql_name(f"_v{i}_{field}")
        parts = [f"'_present', {sql_name(present)}"] + [
            f"{sql_string(f.name)}, CAST({given.get(f.name, 'NULL')} AS "
            f"{f.dataType.simpleString()})" for f in fields]
        structs.append("named_struct(" + ", ".join(parts) + ")")
    presents = list(dict.fromkeys(present for _, _, present, _ in stages))
    pre = grouped.selectExpr(*map(sql_name, [*keys, *presents]), *values)
    rows = pre.selectExpr(*[sql_name(k) for k in keys],
                          "inline(array(" + ", ".join(structs) + "))")
    return align(rows.where(F.col("_present") > 0), extract_schema(schema, keys))


def ux_ride_stages(t: Mapping[str, DataFrame],
                   keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 3-6 (requested, accepted, completed, payment) from one pass over
    the rides and one over the transactions.

    Rides and per-ride transaction counts meet in a full outer join (stages 3-5
    keep rides without transactions, stage 6 transactions without a ride), are
    summed per user and then per (segment, user) (:func:`per_user_segments`),
    keeping per-stage row counts; a second aggregate per segment turns them into
    each stage's ``count(DISTINCT user_id)`` and ``count(user_id)``. Equal to
    stacking :func:`ux_requested`, :func:`ux_accepted`, :func:`ux_completed` and
    :func:`ux_payment`.
    """
    tx = transactions_per_ride(t["transactions"])
    rides = t["ride_requests"].selectExpr("ride_id", "user_id", "accept_ts", "cancel_ts", "1 AS is_ride")
    both = rides.join(tx, rides["ride_id"] == tx["tx_ride_id"], "full")
    per_user = per_user_segments(both, t, {
        "r3": F.expr("count(is_ride)"), "r4": F.expr("count(accept_ts)"),
        "r5": F.expr("sum(CASE WHEN is_ride = 1 AND cancel_ts IS NULL"
                     " THEN coalesce(n_tx, 1L) ELSE 0L END)"),
        "r6": F.expr("sum(coalesce(n_approved, 0L))")}, keys)
    names = {"3": "ride_requested", "4": "ride_accepted", "5": "ride_completed", "6": "payment"}
    aggs = [F.expr(e) for k in names for e in (
        f"sum(r{k}) AS n{k}",
        f"CAST(sum(CASE WHEN user_id IS NOT NULL AND r{k} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS u{k}",
        f"CAST(sum(CASE WHEN user_id IS NOT NULL THEN r{k} ELSE 0 END) AS BIGINT) AS c{k}")]
    grouped = per_user.groupBy(*keys).agg(*aggs)
    stages = [(int(k), name, "n" + k, {"user_count": "u" + k, "ride_count": "c" + k})
              for k, name in names.items()]
    return _stacked(grouped, stages, USER_EXTRACT_SCHEMA, keys)


def user_extract(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """All seven stages stacked, ordered by stage. Stage number and group keys
    are all in the output, so rows are unique and UNION equals UNION ALL.
    Stages 3-6 share one pass over rides and transactions (:func:`ux_ride_stages`)."""
    check_keys(keys)
    parts = [ux_downloads(t, keys), ux_signups(t, keys), ux_ride_stages(t, keys),
             ux_review(t, keys)]
    return union_all(parts).orderBy("funnel_step")


# ---------------------------------------------------------------- ride grain

def _enriched_rides(rides: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    return _segmented(rides.join(user_segments(t["signups"], t["app_downloads"]),
                                 "user_id", "left").drop("download_ts"), "request_ts")


def _ride_stage(step: int, name: str, df: DataFrame, *measures: Column,
                keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Group on the *raw* age group, then COALESCE it: a stored
    'Not specified' and a NULL age stay separate groups that print alike."""
    out = df.groupBy(*keys).agg(
        F.countDistinct("ride_id").cast("bigint").alias("ride_count"), *measures)
    out = _coalesced_age(out)
    return align(out.select(*_tag(step, name), "*"), extract_schema(RIDE_EXTRACT_SCHEMA, keys))


def _avg_minutes(later: str, earlier: str) -> Column:
    return F.avg(minute_field(later, earlier))


def _completed(rides: DataFrame) -> DataFrame:
    return rides.where(F.col("accept_ts").isNotNull() & F.col("dropoff_ts").isNotNull())


def rx_requested(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    df = _enriched_rides(t["ride_requests"], t)
    m = minute_field("cancel_ts", "request_ts")
    return _ride_stage(
        3, "ride_requested", df,
        round_mean_half_up(F.sum(m), F.count(m)).alias("avg_time_ride_requested_cancelled"),
        ratio(F.sum(F.when(F.col("cancel_ts").isNotNull(), 1).otherwise(0)),
              F.count("request_ts")).alias("proportion_of_cancellations"), keys=keys)


def rx_accepted(t: Mapping[str, DataFrame],
                keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    df = _enriched_rides(t["ride_requests"].where(F.col("accept_ts").isNotNull()), t)
    return _ride_stage(
        4, "ride_accepted", df,
        _avg_minutes("accept_ts", "request_ts").alias("avg_time_requested_accepted"),
        _avg_minutes("pickup_ts", "accept_ts").alias("avg_time_accepted_pickup"),
        _avg_minutes("cancel_ts", "accept_ts").alias("avg_time_accepted_cancelled"), keys=keys)


def rx_completed(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    df = _enriched_rides(_completed(t["ride_requests"]), t)
    return _ride_stage(
        5, "ride_completed", df,
        _avg_minutes("pickup_ts", "request_ts").alias("avg_time_requested_pickup"),
        _avg_minutes("dropoff_ts", "pickup_ts").alias("avg_ride_duration"), keys=keys)


def rx_paid(t: Mapping[str, DataFrame],
            keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 6: completed rides with approved transactions (the filter makes
    the join inner); revenue = sum over rides of their approved amount."""
    paid = approved_per_ride(t["transactions"]).select("ride_id", "amount")
    df = _enriched_rides(_completed(t["ride_requests"]).join(paid, "ride_id", "inner"), t)
    return _ride_stage(6, "payment", df, F.sum("amount").alias("sum_purchase_amount"), keys=keys)


def rx_reviewed(t: Mapping[str, DataFrame],
                keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stage 7: stage 6 LEFT JOIN reviews; counts *paid* rides, only the mean
    rating depends on reviews. Mean over the fanned-out rows:
    sum(n_tx * rating_sum) / sum(n_tx * rating_n)."""
    paid = approved_per_ride(t["transactions"]).select("ride_id", "n_tx")
    rated = t["reviews"].where(F.col("ride_id").isNotNull()).groupBy("ride_id").agg(
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_n"))
    rides = _completed(t["ride_requests"]).join(paid, "ride_id", "inner") \
        .join(rated, "ride_id", "left")
    df = _enriched_rides(rides, t)
    total = F.sum(F.col("n_tx") * F.col("rating_sum"))
    count = F.sum(F.col("n_tx") * F.col("rating_n"))
    return _ride_stage(7, "ride reviewed", df, ratio(total, count).alias("avg_rating"), keys=keys)


RIDE_STAGES = [rx_requested, rx_accepted, rx_completed, rx_paid, rx_reviewed]


def _coalesced_age(df: DataFrame) -> DataFrame:
    if "age_range" not in df.columns:
        return df
    return df.withColumn("age_range", F.coalesce(F.col("age_range"), F.lit(NOT_SPECIFIED)))


def rx_ride_stages(t: Mapping[str, DataFrame],
                   keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 3-5 at ride grain from one pass over the enriched rides.

    A first aggregate per (segment, ride) keeps per-stage row counts and the
    integer sums and counts of every minute field, a second per segment adds
    them up: means are sum/count, the rounded mean uses the exact formula,
    ``count(DISTINCT ride_id)`` counts rides present in the stage. Grouping
    is on the raw age group, coalesced afterwards. Equal to stacking
    :func:`rx_requested`, :func:`rx_accepted` and :func:`rx_completed`.
    """
    df = _enriched_rides(t["ride_requests"], t)
    done = "accept_ts IS NOT NULL AND dropoff_ts IS NOT NULL"
    fields = {  # name -> minute field restricted to the rows of its stage
        "rc": minute_field_sql("cancel_ts", "request_ts"),
        "ra": minute_field_sql("accept_ts", "request_ts"),      # NULL unless accepted
        "ap": minute_field_sql("pickup_ts", "accept_ts"),       # NULL unless accepted
        "ac": minute_field_sql("cancel_ts", "accept_ts"),       # NULL unless accepted
        "rp": f"CASE WHEN {done} THEN {minute_field_sql('pickup_ts', 'request_ts')} END",
        "du": f"CASE WHEN {done} THEN {minute_field_sql('dropoff_ts', 'pickup_ts')} END",
    }
    per_ride = df.groupBy(*keys, "ride_id").agg(*map(F.expr, [
        "count(1) AS r3", "count(accept_ts) AS r4", f"count_if({done}) AS r5",
        "count(cancel_ts) AS cancelled", "count(request_ts) AS requested",
        *[f"{a}({m}) AS {name}_{'s' if a == 'sum' else 'n'}" for name, m in fields.items()
          for a in ("sum", "count")]]))
    sums = ["cancelled", "requested"] + [n + sfx for n in fields for sfx in ("_s", "_n")]
    grouped = per_ride.groupBy(*keys).agg(*map(F.expr, [
        *[f"sum(r{k}) AS n{k}" for k in "345"],
        *[f"count_if(ride_id IS NOT NULL AND r{k} > 0) AS u{k}" for k in "345"],
        *[f"sum({c}) AS {c}" for c in sums]]))
    stages = [
        (3, "ride_requested", "n3", {
            "ride_count": "u3",
            "avg_time_ride_requested_cancelled": round_mean_sql("rc_s", "rc_n"),
            "proportion_of_cancellations": ratio_sql("cancelled", "requested")}),
        (4, "ride_accepted", "n4", {
            "ride_count": "u4",
            "avg_time_requested_accepted": ratio_sql("ra_s", "ra_n"),
            "avg_time_accepted_pickup": ratio_sql("ap_s", "ap_n"),
            "avg_time_accepted_cancelled": ratio_sql("ac_s", "ac_n")}),
        (5, "ride_completed", "n5", {
            "ride_count": "u5",
            "avg_time_requested_pickup": ratio_sql("rp_s", "rp_n"),
            "avg_ride_duration": ratio_sql("du_s", "du_n")}),
    ]
    return _coalesced_age(_stacked(grouped, stages, RIDE_EXTRACT_SCHEMA, keys))


def rx_paid_stages(t: Mapping[str, DataFrame],
                   keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 6-7 at ride grain from one pass: both count the same paid rides,
    stage 6 sums their approved amount, stage 7 averages the ratings over the
    (transaction x review) rows. Equal to stacking :func:`rx_paid` and
    :func:`rx_reviewed`."""
    paid = approved_per_ride(t["transactions"])
    rated = t["reviews"].where(F.col("ride_id").isNotNull()).groupBy("ride_id").agg(
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_n"))
    rides = _completed(t["ride_requests"]).join(paid, "ride_id", "inner") \
        .join(rated, "ride_id", "left")
    grouped = _enriched_rides(rides, t).groupBy(*keys).agg(*map(F.expr, [
        "count(1) AS n", "count(DISTINCT ride_id) AS ride_count", "sum(amount) AS amount",
        "sum(n_tx * rating_sum) AS rating_total", "sum(n_tx * rating_n) AS rating_count"]))
    stages = [
        (6, "payment", "n", {"ride_count": "ride_count", "sum_purchase_amount": "amount"}),
        (7, "ride reviewed", "n", {"ride_count": "ride_count",
                                   "avg_rating": ratio_sql("rating_total", "rating_count")}),
    ]
    return _coalesced_age(_stacked(grouped, stages, RIDE_EXTRACT_SCHEMA, keys))


def ride_extract(t: Mapping[str, DataFrame],
                 keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Stages 3-7 at ride grain, SQL UNION: duplicates from the coalesced age
    group are removed (UNION ALL would keep them). Two passes: stages 3-5 over
    all rides, stages 6-7 over the paid ones."""
    check_keys(keys)
    return union_all([rx_ride_stages(t, keys), rx_paid_stages(t, keys)]).distinct()
