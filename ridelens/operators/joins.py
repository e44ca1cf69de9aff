"""Join building blocks of the funnel tables (all LEFT OUTER equi-joins).

Physical strategy is left to AQE: a side below the broadcast threshold at
runtime is broadcast (that threshold is the size check), anything larger is a
sort-merge join, and skewed partitions of the preserved side are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.time import time_parts
from ridelens.operators.skew import heavy_keys, split_left_join
from ridelens.session import stored

APPROVED = "Approved"


def downloads_signups(downloads: DataFrame, signups: DataFrame) -> DataFrame:
    """Downloads LEFT JOIN signups ON app_download_key = session_id."""
    s = signups.select("session_id", "user_id", "age_range")
    return downloads.join(s, downloads.app_download_key == s.session_id, "left") \
                    .drop("session_id")


def signups_downloads(signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """Signups LEFT JOIN downloads ON session_id = app_download_key."""
    a = downloads.select("app_download_key", "platform", "download_ts")
    return signups.join(a, signups.session_id == a.app_download_key, "left") \
                  .drop("app_download_key")


def user_segments(signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """The user dimension ``user_id, age_range, platform, download_ts``:
    signups LEFT JOIN downloads. ``R ⟕ S ⟕ A`` with a null-rejecting S-A
    condition equals ``R ⟕ (S ⟕ A)``, so every enrichment joins this once."""
    return signups_downloads(signups, downloads) \
        .select("user_id", "age_range", "platform", "download_ts")


def enrich_rides(rides: DataFrame, signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """Rides LEFT JOIN signups ON user_id LEFT JOIN downloads ON session."""
    return rides.join(user_segments(signups, downloads), "user_id", "left")


def approved(transactions: DataFrame) -> DataFrame:
    """case-sensitive ``charge_status = 'Approved'``."""
    return transactions.where(F.col("charge_status") == APPROVED)


def transaction_multiplicity(transactions: DataFrame) -> DataFrame:
    """``ride_id, n_tx``: rows per ride, pre-aggregated map-side so a join
    only ships one row per ride instead of every transaction."""
    return transactions.where(F.col("ride_id").isNotNull()) \
        .groupBy("ride_id").agg(F.count(F.lit(1)).alias("n_tx"))


def transactions_per_ride(transactions: DataFrame) -> DataFrame:
    """``tx_ride_id, n_tx, n_approved``: all and approved transactions per ride, from
    one pass (NULL ride ids are a group of their own)."""
    return transactions.groupBy(F.col("ride_id").alias("tx_ride_id")).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.count_if(F.col("charge_status") == APPROVED).alias("n_approved"))


def approved_per_ride(transactions: DataFrame) -> DataFrame:
    """``ride_id, n_tx, amount``: approved transactions and their summed amount
    per ride (NULL ride ids kept as their own group)."""
    return approved(transactions).groupBy("ride_id").agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum("purchase_amount_usd").alias("amount"))


def reviews_with_time(reviews: DataFrame, rides: DataFrame) -> DataFrame:
    """J9 + X2: reviews LEFT JOIN rides, with the ride request's calendar parts."""
    return with_request_time(reviews.select("ride_id", "user_id", "rating", "review"), rides)


def with_request_time(reviews: DataFrame, rides: DataFrame) -> DataFrame:
    """``reviews`` (any columns, including ``ride_id``) LEFT JOIN rides.
    Output: ``user_id`` (if present), ``year, month, hour`` of the ride
    request, then the other review columns; ``ride_id`` is dropped. Per-row
    work on the reviews (labels,
    phrase counts) can run before this join, so only its results - not the
    text - need to travel to the join when the text is not in the output.
    Both sides reach the join as plain shuffles (or the rides as a broadcast
    when AQE measures them small), so AQE can split the partition of a ride
    id that holds a third of the reviews."""
    r = rides.select("ride_id", "request_ts")
    lead = ["user_id"] if "user_id" in reviews.columns else []
    rest = [c for c in reviews.columns if c not in ("ride_id", "user_id")]
    return reviews.join(r, "ride_id", "left").select(
        *lead, *time_parts("request_ts"), *rest)


def completed_with_payments(rides: DataFrame, transactions: DataFrame,
                            signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """J4 row level: rides LEFT JOIN transactions LEFT JOIN signups LEFT JOIN
    downloads WHERE cancel_ts IS NULL; one row per (ride, transaction). A ride
    with very many transactions is split on their side, where AQE cannot."""
    t = transactions.select(F.col("ride_id").alias("tx_ride_id"), "charge_status")
    r = rides.where(F.col("cancel_ts").isNull()).select("ride_id", "user_id")
    paid = stored(split_left_join(r, t, "ride_id", "tx_ride_id", heavy_right=heavy_keys(t, "tx_ride_id")))
    users = user_segments(signups, downloads).withColumnRenamed("user_id", "signup_user_id")
    return split_left_join(paid, users, "user_id", "signup_user_id", heavy_keys(paid, "user_id"))


def payment_users(transactions: DataFrame, rides: DataFrame,
                  signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """J5 row level: approved transactions LEFT JOIN rides LEFT JOIN user dim.

    Rides with very many transactions, and users with very many paid rides, are split by
    the plan; transactions without a ride (no user) are not shuffled to the users."""
    t = approved(transactions).select(F.col("ride_id").alias("tx_ride_id"),
                                      "purchase_amount_usd")
    r = rides.select("ride_id", "user_id")
    ridden = stored(split_left_join(t, r, "tx_ride_id", "ride_id", heavy_keys(t, "tx_ride_id")))
    users = user_segments(signups, downloads).withColumnRenamed("user_id", "signup_user_id")
    return split_left_join(ridden, users, "user_id", "signup_user_id", heavy_keys(ridden, "user_id"))


def review_users(reviews: DataFrame, rides: DataFrame,
                 signups: DataFrame, downloads: DataFrame) -> DataFrame:
    """J6 row level: reviews LEFT JOIN rides (fan-out only) LEFT JOIN the user
    dimension on the *review's* user."""
    r = rides.select(F.col("ride_id"), F.col("request_ts"))
    re = reviews.select("ride_id", "user_id", "rating")
    return re.join(r, "ride_id", "left") \
             .join(user_segments(signups, downloads), "user_id", "left")


def rides_paid(rides: DataFrame, signups: DataFrame, downloads: DataFrame,
               transactions: DataFrame) -> DataFrame:
    """J7 + F5 row level: enriched completed rides joined to their approved
    transactions. The WHERE on the transaction side turns the LEFT JOIN into
    an inner join (Catalyst plans it so)."""
    t = transactions.select("ride_id", "purchase_amount_usd", "charge_status")
    done = rides.where(F.col("accept_ts").isNotNull() & F.col("dropoff_ts").isNotNull())
    return enrich_rides(done, signups, downloads).join(t, "ride_id", "left") \
        .where(F.col("charge_status") == APPROVED)


def rides_reviewed(rides: DataFrame, signups: DataFrame, downloads: DataFrame,
                   transactions: DataFrame, reviews: DataFrame) -> DataFrame:
    """J8 row level: J7 LEFT JOIN reviews on the transaction's ride."""
    re = reviews.select("ride_id", F.col("rating"))
    return rides_paid(rides, signups, downloads, transactions).join(re, "ride_id", "left")
