"""Registry of named queries, one per operator key of SURVEY §2.

``BUILDERS`` maps a key to a function of the five funnel tables (any mapping
of name -> DataFrame: Parquet or JDBC tables, hand-made test tables);
``QUERIES`` maps the same key to ``(spark, sf_dir) -> DataFrame`` over the
fixture views of the driver tables. Every query runs over whole tables and
whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.functions.numeric import ratio, round_mean_half_up
from ridelens.functions.time import minute_field, time_parts
from ridelens.operators import bitmaps, funnel, increments, joins, keywords, phrase_join, sampling, segments, summaries
from ridelens.operators.setops import constant_row, union_all, union_distinct
from ridelens.session import new_scratch_path
from ridelens.sources import csv as csv_io
from ridelens.sources import infer
from ridelens.sources.fixtures import fixture_tables
from ridelens.sources.profile import profile
from ridelens.sources.tables import table_row_counts

Query = Callable[[SparkSession, str], DataFrame]
SAMPLE_SEED = 42
SAMPLE_SIZE = 200          # below the fixture's review count, so the order matters
SEGMENTS = segments.SEGMENT_KEYS

CLASSIFIED_SCHEMA = (
    "user_id BIGINT, year BIGINT, month BIGINT, hour BIGINT, rating INT, review STRING, "
    "app STRING, app_val BIGINT, driver STRING, driver_val BIGINT, ride STRING, "
    "ride_val BIGINT, price STRING, price_val BIGINT, wait_time STRING, wait_time_val BIGINT")


Tables = Mapping[str, DataFrame]


def _reviews_with_time(t):
    return joins.reviews_with_time(t["reviews"], t["ride_requests"])


def _reviews(t):
    return t["reviews"].select("ride_id", "user_id", "rating", "review")


def _timed(t, per_review):
    """Per-row review work first, then the rides join: the join moves the
    results (and the text only where the output keeps it)."""
    return joins.with_request_time(per_review, t["ride_requests"])


def _classified(t):
    return _timed(t, keywords.classify_reviews(_reviews(t)))


def _enriched(t):
    return joins.enrich_rides(t["ride_requests"], t["signups"], t["app_downloads"])


# ------------------------------------------------------------ sources / sinks

def q_scan_tables(t):
    return table_row_counts(t)


def q_profile_reviews(t):
    return profile(_reviews_with_time(t))


def q_csv_roundtrip(t):
    df = _classified(t)
    spark = df.sparkSession
    path = csv_io.write_csv(df, new_scratch_path(spark, "classified-reviews-csv"))
    return csv_io.read_csv(spark, path, CLASSIFIED_SCHEMA,
                           empty_as_blank=keywords.LABEL_ASPECTS)


def q_csv_inferred_types(t):
    df = _classified(t)
    path = csv_io.write_csv(df, new_scratch_path(df.sparkSession, "classified-reviews-csv"))
    return infer.inferred_types(infer.read_csv_texts(df.sparkSession, path, df.columns))


# ------------------------------------------------------------------ filters

def q_filter_stage_reached(t):
    r = t["ride_requests"]
    return r.where(F.col("accept_ts").isNotNull()).select("ride_id", "user_id", "accept_ts")


def q_filter_not_cancelled(t):
    r = t["ride_requests"]
    return r.where(F.col("cancel_ts").isNull()).select("ride_id", "user_id", "request_ts")


def q_filter_approved(t):
    return joins.approved(t["transactions"])


def q_left_join_filtered(t):
    tx = t["transactions"]
    r = t["ride_requests"].select("ride_id", "user_id")
    return r.join(tx, "ride_id", "left").where(F.col("charge_status") == joins.APPROVED) \
            .select("ride_id", "user_id", "purchase_amount_usd")


# -------------------------------------------------------------------- joins

def q_join_downloads_signups(t):
    return joins.downloads_signups(t["app_downloads"], t["signups"]).select(
        "app_download_key", "platform", "download_ts", "user_id", "age_range")


def q_join_signups_downloads(t):
    return joins.signups_downloads(t["signups"], t["app_downloads"]).select(
        "user_id", "session_id", "age_range", "platform", "download_ts")


def q_enrich_rides(t):
    return _enriched(t).select(
        "ride_id", "user_id", "request_ts", "platform", "age_range", "download_ts")


def q_join_fanout_completed(t):
    return joins.completed_with_payments(t["ride_requests"], t["transactions"], t["signups"],
                                         t["app_downloads"]).select(
        "ride_id", "user_id", "charge_status", "platform", "age_range")


def q_payment_users(t):
    return joins.payment_users(t["transactions"], t["ride_requests"], t["signups"],
                               t["app_downloads"]).select(
        "tx_ride_id", "purchase_amount_usd", "user_id", "platform", "age_range")


def q_review_users(t):
    return joins.review_users(t["reviews"], t["ride_requests"], t["signups"],
                              t["app_downloads"]).select(
        "ride_id", "user_id", "rating", "request_ts", "platform", "age_range")


def q_rides_paid(t):
    return joins.rides_paid(t["ride_requests"], t["signups"], t["app_downloads"],
                            t["transactions"]).select(
        "ride_id", "user_id", "platform", "age_range", "purchase_amount_usd")


def q_rides_reviewed(t):
    return joins.rides_reviewed(t["ride_requests"], t["signups"], t["app_downloads"],
                                t["transactions"], t["reviews"]).select(
        "ride_id", "user_id", "platform", "age_range", "purchase_amount_usd", "rating")


def q_reviews_with_time(t):
    return _reviews_with_time(t)


# ------------------------------------------------------------- aggregations

def q_count_distinct_global(t):
    # One aggregate per key, each without an Expand of the rides; their one-row
    # results are put side by side.
    r, nothing = t["ride_requests"], F.lit(None).cast("bigint")
    users = r.agg(F.countDistinct("user_id").alias("users")).select("users", nothing.alias("rides"))
    rides = r.agg(F.countDistinct("ride_id").alias("rides")).select(nothing.alias("users"), "rides")
    return users.union(rides).agg(F.max("users").alias("users"), F.max("rides").alias("rides"))


def _request_segmented(t, rides=None):
    rides = t["ride_requests"] if rides is None else rides
    e = joins.enrich_rides(rides, t["signups"], t["app_downloads"])
    return e.select("*", *time_parts("request_ts"))


def _rides_per_user_segment(t):
    # rides summed per user before the user dimension is joined (hot users)
    rides = t["ride_requests"].select("user_id")
    return segments.per_user_segments(rides, t, {"rides": F.count(F.lit(1))})


def q_count_distinct_segment(t):
    known = F.col("user_id").isNotNull()
    return _rides_per_user_segment(t).groupBy(*SEGMENTS).agg(
        F.sum(F.when(known, 1).otherwise(0)).cast("bigint").alias("user_count"))


def q_count_segment(t):
    known = F.col("user_id").isNotNull()
    return _rides_per_user_segment(t).groupBy(*SEGMENTS).agg(
        F.sum(F.when(known, F.col("rides")).otherwise(0)).cast("bigint").alias("ride_count"))


def q_avg_minutes_segment(t):
    acc = t["ride_requests"].where(F.col("accept_ts").isNotNull())
    return _request_segmented(t, acc).groupBy(*SEGMENTS).agg(
        F.avg(minute_field("pickup_ts", "accept_ts")).alias("avg_time_accepted_pickup"))


def q_avg_minutes_rounded(t):
    m = minute_field("cancel_ts", "request_ts")
    return _request_segmented(t).groupBy(*SEGMENTS).agg(
        round_mean_half_up(F.sum(m), F.count(m)).alias("avg_time_ride_requested_cancelled"))


def q_cancel_proportion(t):
    cancelled = F.sum(F.when(F.col("cancel_ts").isNotNull(), 1).otherwise(0))
    return _request_segmented(t).groupBy(*SEGMENTS).agg(
        ratio(cancelled, F.count("request_ts")).alias("proportion_of_cancellations"))


def q_revenue_segment(t):
    df = segments.rx_paid(t)
    return df.select(*SEGMENTS, "ride_count", "sum_purchase_amount")


def q_rating_segment(t):
    df = segments.rx_reviewed(t)
    return df.select(*SEGMENTS, "ride_count", "avg_rating")


def q_coalesce_after_group(t):
    done = t["ride_requests"].where(F.col("accept_ts").isNotNull()
                                    & F.col("dropoff_ts").isNotNull())
    g = _request_segmented(t, done).groupBy(*SEGMENTS).agg(
        F.countDistinct("ride_id").cast("bigint").alias("ride_count"))
    return g.withColumn("age_range", F.coalesce(F.col("age_range"),
                                                F.lit(segments.NOT_SPECIFIED))).distinct()


# Distinct counts at several subsets of the segments from one set of bitmaps.
ROLLUP_SUBSETS = [SEGMENTS, ["platform", "age_range", "year", "month"], ["year", "month"],
                  ["platform", "hour"], ["age_range"], []]
REACHED = {"requested": "true", "accepted": "accept_ts IS NOT NULL", "completed": "dropoff_ts IS NOT NULL"}


def _distinct_rollup(segmented, key):
    maps = bitmaps.distinct_bitmaps(segmented, key, SEGMENTS, REACHED)
    return bitmaps.distinct_rollup(maps, SEGMENTS, list(REACHED), ROLLUP_SUBSETS)


def q_distinct_users_rollup(t):
    # a user's rides of one (year, month, hour) are one row before the user dimension is joined
    timed = t["ride_requests"].select("user_id", *time_parts("request_ts"), "accept_ts", "dropoff_ts")
    per_user = timed.groupBy("user_id", "year", "month", "hour").agg(
        F.max("accept_ts").alias("accept_ts"), F.max("dropoff_ts").alias("dropoff_ts"))
    return _distinct_rollup(joins.enrich_rides(per_user, t["signups"], t["app_downloads"]), "user_id")


def q_distinct_rides_rollup(t):
    return _distinct_rollup(_request_segmented(t), "ride_id")


INCREMENT_KEYS = ["platform", "age_range", "year", "month"]


def q_incremental_rides(t):
    """Rides arrive in two batches, each with rides of all days; the second runs twice."""
    spark = t["ride_requests"].sparkSession
    store = increments.PartialStore(spark, new_scratch_path(spark, "ride-partials"))
    for batch in (0, 1, 1):
        rides = t["ride_requests"].where(F.pmod(F.coalesce("ride_id", F.lit(0)), F.lit(2)) == batch)
        store.add(f"b{batch}", {"ride_requests": rides, "signups": t["signups"], "app_downloads": t["app_downloads"]})
    return store.extract(INCREMENT_KEYS)


def q_time_parts(t):
    a = t["app_downloads"]
    return a.select("app_download_key", *time_parts("download_ts"))


def q_interval_minutes(t):
    r = t["ride_requests"]
    return r.select(
        "ride_id",
        minute_field("accept_ts", "request_ts").alias("requested_accepted"),
        minute_field("pickup_ts", "accept_ts").alias("accepted_pickup"),
        minute_field("pickup_ts", "request_ts").alias("requested_pickup"),
        minute_field("cancel_ts", "request_ts").alias("requested_cancelled"),
        minute_field("cancel_ts", "accept_ts").alias("accepted_cancelled"),
        minute_field("dropoff_ts", "pickup_ts").alias("ride_duration"))


# ----------------------------------------------------------------- set ops

def q_union_distinct(t):
    users = joins.user_segments(t["signups"], t["app_downloads"]).select("platform", "age_range")
    riders = _enriched(t).select("platform", "age_range")
    return union_distinct([users, riders])


def q_union_constant_rows(t):
    null_count = F.lit(None).cast("bigint").alias("count")
    return union_all([
        constant_row(t["app_downloads"], F.lit(1).alias("step"),
                     F.lit("app_downloads").alias("funnel_name"), null_count),
        constant_row(t["signups"], F.lit(2).alias("step"),
                     F.lit("signups").alias("funnel_name"), null_count)])


# ------------------------------------------------------------------ funnels

def q_funnel_ratios(t):
    counts = funnel.funnel_counts(funnel.user_funnel_steps(t))
    return funnel.funnel_ratios(counts, 6, "user_count")


def q_user_funnel(t):
    return funnel.user_funnel(t)


def q_ride_funnel(t):
    return funnel.ride_funnel(t)


def q_stage_conversion(t):
    return funnel.stage_conversion(t)


# ------------------------------------------------------------------ reviews

def q_review_sample(t):
    return sampling.review_sample(t["reviews"], t["ride_requests"], n=SAMPLE_SIZE,
                                  seed=SAMPLE_SEED)


def q_review_sample_third(t):
    n = t["reviews"].count() // 3
    return sampling.ranked_review_sample(t["reviews"], t["ride_requests"], n=n, seed=SAMPLE_SEED)


def q_keyword_flags(t):
    return _timed(t, keywords.keyword_flags(_reviews(t)))


def q_aspect_labels(t):
    return _timed(t, keywords.aspect_labels(keywords.keyword_flags(_reviews(t))))


def q_classified_reviews(t):
    return _classified(t)


# The review aggregates below join per-review results (not the text) to the
# rides. Their aggregate after the join is global or keyed by time and label,
# so a ride id held by a third of the reviews is a skewed join partition that
# AQE's skew join splits without adding a shuffle.

def _per_joined_ride(t, per_review):
    """Per-review results as often as their ride id occurs. Only a count is
    wanted of the rides, so where no ride id occurs twice there is no join."""
    ids = t["ride_requests"].select("ride_id").where(F.col("ride_id").isNotNull())
    repeated = ids.groupBy("ride_id").count().where(F.col("count") > 1)
    return per_review if repeated.isEmpty() else _timed(t, per_review)


def q_flag_value_counts(t):
    flags = keywords.keyword_flags(_reviews(t)).drop("review")
    return keywords.flag_value_counts(_per_joined_ride(t, flags))


def q_keyword_counts(t):
    matched = keywords.keyword_matches(_reviews(t).select("ride_id", "user_id", "review"))
    return keywords.keyword_totals(_per_joined_ride(t, matched))


def q_top_keywords(t):
    return keywords.top_keywords(q_keyword_counts(t))


# A dictionary that grows with the reviews: the last three words of each.
ENDING = r"([^ \n]+ [^ \n]+ [^ \n]+)\z"


def q_phrase_table_counts(t):
    reviews = t["reviews"].select("review")
    # the ending has two blanks: it lies behind the third last one, and only there is it looked for
    last = F.substring_index(F.lower("review"), " ", -3)
    phrases = reviews.select(F.regexp_extract(last, ENDING, 1).alias("phrase"))
    return phrase_join.phrase_counts(reviews, phrases)


def q_sentiment_rollup(t):
    labels = keywords.classify_reviews(_reviews(t)).drop("review")
    return keywords.sentiment_rollup(_timed(t, labels))


# ---------------------------------------------------------------- summaries

def q_platform_summary(t):
    return summaries.platform_summary(t)


def q_age_value_summary(t):
    return summaries.age_value_summary(t)


def q_hourly_demand(t):
    return summaries.hourly_demand(t)


BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_tables": q_scan_tables,
    "profile_reviews": q_profile_reviews,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_inferred_types": q_csv_inferred_types,
    "filter_stage_reached": q_filter_stage_reached,
    "filter_not_cancelled": q_filter_not_cancelled,
    "filter_approved": q_filter_approved,
    "left_join_filtered": q_left_join_filtered,
    "join_downloads_signups": q_join_downloads_signups,
    "join_signups_downloads": q_join_signups_downloads,
    "enrich_rides": q_enrich_rides,
    "join_fanout_completed": q_join_fanout_completed,
    "payment_users": q_payment_users,
    "review_users": q_review_users,
    "rides_paid": q_rides_paid,
    "rides_reviewed": q_rides_reviewed,
    "reviews_with_time": q_reviews_with_time,
    "count_distinct_global": q_count_distinct_global,
    "count_distinct_segment": q_count_distinct_segment,
    "count_segment": q_count_segment,
    "avg_minutes_segment": q_avg_minutes_segment,
    "avg_minutes_rounded": q_avg_minutes_rounded,
    "cancel_proportion": q_cancel_proportion,
    "revenue_segment": q_revenue_segment,
    "rating_segment": q_rating_segment,
    "coalesce_after_group": q_coalesce_after_group,
    "distinct_users_rollup": q_distinct_users_rollup,
    "distinct_rides_rollup": q_distinct_rides_rollup,
    "incremental_rides": q_incremental_rides,
    "time_parts": q_time_parts,
    "interval_minutes": q_interval_minutes,
    "union_distinct": q_union_distinct,
    "union_constant_rows": q_union_constant_rows,
    "funnel_ratios": q_funnel_ratios,
    "user_funnel": q_user_funnel,
    "ride_funnel": q_ride_funnel,
    "stage_conversion": q_stage_conversion,
    "ux_downloads": segments.ux_downloads,
    "ux_signups": segments.ux_signups,
    "ux_requested": segments.ux_requested,
    "ux_accepted": segments.ux_accepted,
    "ux_completed": segments.ux_completed,
    "ux_payment": segments.ux_payment,
    "ux_review": segments.ux_review,
    "user_extract": segments.user_extract,
    "rx_requested": segments.rx_requested,
    "rx_accepted": segments.rx_accepted,
    "rx_completed": segments.rx_completed,
    "rx_paid": segments.rx_paid,
    "rx_reviewed": segments.rx_reviewed,
    "ride_extract": segments.ride_extract,
    "review_sample": q_review_sample,
    "review_sample_third": q_review_sample_third,
    "keyword_flags": q_keyword_flags,
    "aspect_labels": q_aspect_labels,
    "classified_reviews": q_classified_reviews,
    "flag_value_counts": q_flag_value_counts,
    "keyword_counts": q_keyword_counts,
    "top_keywords": q_top_keywords,
    "phrase_table_counts": q_phrase_table_counts,
    "sentiment_rollup": q_sentiment_rollup,
    "platform_summary": q_platform_summary,
    "age_value_summary": q_age_value_summary,
    "hourly_demand": q_hourly_demand,
}


def _on_fixtures(build: Callable[[Tables], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(fixture_tables(spark, sf_dir))
    query.__name__ = build.__name__
    return query


# key -> (spark, sf_dir) -> DataFrame over the fixture views of the driver tables
QUERIES: dict[str, Query] = {key: _on_fixtures(b) for key, b in BUILDERS.items()}
