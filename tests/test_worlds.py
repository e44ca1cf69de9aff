"""Every query on hand-made tables - the trap world, an all-empty world and a
skewed world (one user with a third of the rides, one ride with a third of
the transactions and reviews) - against the same DuckDB texts run over
identical copies of the tables."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from ridelens.plans.oracle import oracle_sql_over_tables
from ridelens.plans.registry import BUILDERS
from ridelens.sources.fixtures import REVIEW_PHRASES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))
from check_oracle import _norm  # noqa: E402

ORACLE = oracle_sql_over_tables()


def skewed_world(spark, rides=3000, users=300):
    epoch = F.expr("TIMESTAMP_NTZ '2022-01-01 00:00:00'")
    i = F.col("id")
    plus = lambda secs: F.timestamp_add("SECOND", secs, epoch)
    downloads = spark.range(1, users + 1).select(
        i.alias("app_download_key"),
        F.element_at(F.array(*map(F.lit, ["ios", "android", "web"])), (i % 3 + 1).cast("int"))
         .alias("platform"),
        plus(i * 3600 * 7).alias("download_ts"))
    ages = F.array(*map(F.lit, ["18-24", "25-34", "Not specified", "45-54"]))
    signups = spark.range(1, users + 1).where(i % 7 != 0).select(
        i.alias("user_id"), i.alias("session_id"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.element_at(ages, (i % 4 + 1).cast("int")))
         .alias("age_range"))
    req = plus(i * 1789)
    ride_requests = spark.range(rides).select(
        i.alias("ride_id"),
        F.when(i % 3 == 0, F.lit(1)).otherwise(i % users + 1).cast("bigint").alias("user_id"),
        req.alias("request_ts"),
        F.when(i % 5 != 0, F.timestamp_add("SECOND", i % 900 + 60, req)).alias("accept_ts"),
        F.when(i % 5 > 1, F.timestamp_add("SECOND", i % 2000 + 1000, req)).alias("pickup_ts"),
        F.when(i % 5 > 2, F.timestamp_add("SECOND", i % 9000 + 4000, req)).alias("dropoff_ts"),
        F.when(i % 5 < 2, F.timestamp_add("SECOND", i % 3000 - 400, req)).alias("cancel_ts"))
    transactions = spark.range(3 * rides).select(
        F.when(i % 3 == 0, F.lit(7)).otherwise(i % (rides + 50)).cast("bigint").alias("ride_id"),
        ((i % 1000) / 100).cast("decimal(12,2)").alias("purchase_amount_usd"),
        F.when(i % 4 == 0, F.lit("Declined")).otherwise(F.lit("Approved")).alias("charge_status"))
    phrases = F.array(*map(F.lit, REVIEW_PHRASES))
    reviews = spark.range(rides // 2).select(
        F.when(i % 3 == 0, F.lit(7)).otherwise(i * 2).cast("bigint").alias("ride_id"),
        (i % users + 1).alias("user_id"),
        (i % 5 + 1).cast("int").alias("rating"),
        F.concat(F.element_at(phrases, (i % len(REVIEW_PHRASES) + 1).cast("int")), F.lit(" #"),
                 i.cast("string")).alias("review"))
    # duplicated ride ids (two requests sharing ids 7 and 8, another user and time):
    # every join on ride_id fans out
    dup = ride_requests.where(F.col("ride_id").isin(7, 8)).select(
        "ride_id", (F.col("user_id") + 5).alias("user_id"),
        F.timestamp_add("HOUR", F.lit(30), F.col("request_ts")).alias("request_ts"),
        "accept_ts", "pickup_ts", "dropoff_ts", "cancel_ts")
    ride_requests = ride_requests.unionByName(dup)
    return {"app_downloads": downloads, "signups": signups, "ride_requests": ride_requests,
            "transactions": transactions, "reviews": reviews}


@pytest.fixture(scope="module")
def worlds(spark):
    from tests.conftest import SCHEMAS
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    return {"empty": empty, "skewed": skewed_world(spark)}


def run_world(spark, tables, key):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = BUILDERS[key](tables)
    s_rows, s_cols = [tuple(r) for r in got.collect()], got.columns
    rel = con.sql(ORACLE[key])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols), key
    order = [d_cols.index(c) for c in s_cols]
    norm = lambda rows: sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)  # noqa
    assert norm(s_rows) == norm([tuple(r[i] for i in order) for r in d_rows]), key


@pytest.mark.parametrize("key", sorted(BUILDERS))
def test_trap_world(spark, small_world, key):
    run_world(spark, small_world, key)


@pytest.mark.parametrize("key", sorted(BUILDERS))
def test_empty_world(spark, worlds, key):
    run_world(spark, worlds["empty"], key)


@pytest.mark.parametrize("key", sorted(BUILDERS))
def test_skewed_world(spark, worlds, key):
    run_world(spark, worlds["skewed"], key)
