"""The summaries behind the headline findings (platform, age group,
hour of day), computed from the base tables, not re-aggregated from extracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.numeric import ratio
from ridelens.operators.joins import approved_per_ride, user_segments


def _per_user_by(t: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Per user: ride rows, completed rides and approved amount (amount
    pre-aggregated per ride, so no transaction fan-out), summed per user
    *before* the user dimension is joined - a user with a third of all rides
    collapses in the map-side combine - then per (key, user)."""
    paid = approved_per_ride(t["transactions"]).select("ride_id", "amount")
    rides = t["ride_requests"].select("ride_id", "user_id", "dropoff_ts")
    per_user = rides.join(paid, "ride_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rides"), F.count("dropoff_ts").alias("done"),
        F.sum("amount").alias("amount"))
    dim = user_segments(t["signups"], t["app_downloads"]).select("user_id", key)
    return per_user.join(dim, "user_id", "left").groupBy(key, "user_id").agg(
        F.sum("rides").alias("rides"), F.sum("done").alias("done"),
        F.sum("amount").alias("amount"))


def _users() -> F.Column:
    """``count(DISTINCT user_id)`` over rows unique per (group, user)."""
    return F.sum(F.when(F.col("user_id").isNotNull(), 1).otherwise(0)).cast("bigint")


def platform_summary(t: Mapping[str, DataFrame]) -> DataFrame:
    """``platform, users, ride_requests, completed_rides, revenue``."""
    return _per_user_by(t, "platform").groupBy("platform").agg(
        _users().alias("users"),
        F.sum("rides").cast("bigint").alias("ride_requests"),
        F.sum("done").cast("bigint").alias("completed_rides"),
        F.sum("amount").cast("decimal(38,2)").alias("revenue"))


def age_value_summary(t: Mapping[str, DataFrame]) -> DataFrame:
    """``age_range, users, revenue, revenue_per_user`` by the stored age group."""
    out = _per_user_by(t, "age_range").groupBy("age_range").agg(
        _users().alias("users"), F.sum("amount").cast("decimal(38,2)").alias("revenue"))
    return out.select("*", ratio(F.col("revenue"), F.col("users")).alias("revenue_per_user"))


def hourly_demand(t: Mapping[str, DataFrame]) -> DataFrame:
    """``hour, requests, accepted, completed, cancelled`` by request hour."""
    r = t["ride_requests"]
    return r.groupBy(F.hour("request_ts").cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.count("accept_ts").cast("bigint").alias("accepted"),
        F.count("dropoff_ts").cast("bigint").alias("completed"),
        F.count("cancel_ts").cast("bigint").alias("cancelled"))
