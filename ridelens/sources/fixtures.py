"""Binding of the funnel tables to the driver's TPC-H-like Parquet tables.

The driver ships ``customer``, ``orders``, ``lineitem`` and ``documents``;
each funnel table is a deterministic view over them (see FIXTURES.md). The same
expressions, in DuckDB SQL, head every oracle text in ``ridelens.plans.oracle``.
Views stay lazy, so only the columns a query uses are read.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ridelens.functions.text import sql_string
from ridelens.sources.tables import dealt_out

# Fixed values of the fixture binding (FIXTURES.md): platform by key % 3,
# age group by nation % 6 (index 5 is NULL), review opening phrase by doc % 11.
PLATFORMS = ["ios", "android", "web"]
AGE_RANGES = ["18-24", "25-34", "35-44", "45-54", "Not specified", None]
REVIEW_PHRASES = [
    "Drivers were courteous and the ride arrived on time",
    "the app had constant glitches, GPS crashed repeatedly",
    "A bit unfriendly driver, he got lost",
    "the car was not clean and quite uncomfortable",
    "Great service! great service!",
    "fare increased, I was overcharged",
    "the wait time was longer than expected, ride arrived late",
    "app is easy; pickup promptly",
    "vehicle was fine",
    "the trip was unsafe and the driver rude, rude, RUDE",
    "no comment",
]
DOWNLOAD_EPOCH = "1994-01-01 00:00:00"
# The driver-table columns the binding reads, with their stored
# types. Declaring them skips the schema-inference job of every scan; a test
# checks them against the files at each scale.
BASE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, "
                "l_returnflag STRING",
    "documents": "doc_id BIGINT, text STRING",
}


def _pick(index: str, values: list) -> str:
    """SQL ``values[index]`` as a CASE (NULL entries give NULL)."""
    whens = " ".join(f"WHEN {i} THEN {sql_string(v)}"
                     for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {whens} END"


def _plus_seconds(ts: str, seconds: str) -> str:
    return f"timestampadd(SECOND, {seconds}, {ts})"


# Each view is one projection written as Spark SQL expressions (one call into
# the JVM per view); the DuckDB texts in ridelens.plans.oracle mirror them.

def app_downloads(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS app_download_key",
        f"{_pick('c_custkey % 3', PLATFORMS)} AS platform",
        f"timestampadd(HOUR, 744 * (c_custkey % 4) + c_custkey % 6, "
        f"TIMESTAMP_NTZ '{DOWNLOAD_EPOCH}') AS download_ts")


def signups(customer: DataFrame) -> DataFrame:
    return customer.where("c_custkey % 8 <> 0").selectExpr(
        "c_custkey AS user_id", "c_custkey AS session_id",
        f"{_pick('c_nationkey % 6', AGE_RANGES)} AS age_range")


def ride_requests(orders: DataFrame) -> DataFrame:
    request = _plus_seconds("o_orderdate", "3600 * (o_orderkey % 5) + o_orderkey % 3600")
    k = "o_orderkey"
    return orders.selectExpr(
        f"{k} AS ride_id", "o_custkey AS user_id", f"{request} AS request_ts",
        f"CASE WHEN o_orderstatus <> 'P' THEN "
        f"{_plus_seconds(request, f'60 * ({k} % 80 + 7) + {k} % 60')} END AS accept_ts",
        f"CASE WHEN o_orderstatus = 'O' THEN "
        f"{_plus_seconds(request, f'60 * ({k} % 90 + 20) + {k} % 60')} END AS pickup_ts",
        f"CASE WHEN o_orderstatus = 'O' AND {k} % 9 <> 0 THEN "
        f"{_plus_seconds(request, f'60 * ({k} % 150 + 120)')} END AS dropoff_ts",
        f"CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'F' AND {k} % 4 <> 0) THEN "
        f"{_plus_seconds(request, f'60 * ({k} % 95) + 30')} END AS cancel_ts")


def transactions(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "CASE WHEN l_linenumber = 7 THEN -1 - l_orderkey ELSE l_orderkey END AS ride_id",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS purchase_amount_usd",
        "CASE WHEN l_returnflag = 'R' THEN 'Declined' ELSE 'Approved' END AS charge_status")


def reviews(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews: an opening phrase from ``REVIEW_PHRASES`` followed by the whole
    document text, so keyword work scales with the real text volume."""
    d = documents.select("doc_id", "text")
    o = orders.select("o_orderkey", "o_custkey")
    phrase = _pick("doc_id % 11", REVIEW_PHRASES)
    return d.join(o, d.doc_id * 17 == o.o_orderkey, "left").selectExpr(
        "doc_id * 17 AS ride_id",
        "coalesce(o_custkey, doc_id) AS user_id",
        "CAST(doc_id % 5 + 1 AS INT) AS rating",
        f"concat(CASE WHEN doc_id % 13 = 0 THEN upper({phrase}) ELSE {phrase} END, ' ', text)"
        " AS review")


class FixtureTables(Mapping):
    """The five funnel tables over the driver tables in ``sf_dir``, each view
    (and each base scan) created on first use, so a query only plans the
    tables it reads."""

    _VIEWS = {
        "app_downloads": (app_downloads, ("customer",)),
        "signups": (signups, ("customer",)),
        "ride_requests": (ride_requests, ("orders",)),
        "transactions": (transactions, ("lineitem",)),
        "reviews": (reviews, ("documents", "orders")),
    }

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: Mapping[str, int] | None = None):
        self._spark, self._dir, self._partitions = spark, sf_dir, partitions
        self._base: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def _scan(self, name: str) -> DataFrame:
        if name not in self._base:
            scan = self._spark.read.schema(BASE_SCHEMAS[name]).parquet(
                os.path.join(self._dir, f"{name}.parquet"))
            self._base[name] = dealt_out(scan, name, self._partitions)
        return self._base[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._views:
            build, sources = self._VIEWS[name]
            self._views[name] = build(*[self._scan(s) for s in sources])
        return self._views[name]

    def __iter__(self):
        return iter(self._VIEWS)

    def __len__(self):
        return len(self._VIEWS)


def fixture_tables(spark: SparkSession, sf_dir: str,
                   partitions: Mapping[str, int] | None = None) -> FixtureTables:
    """The five funnel tables as lazy views over the driver tables in ``sf_dir``;
    ``partitions`` deals driver tables out to that many tasks each."""
    return FixtureTables(spark, sf_dir, partitions)


__all__ = ["fixture_tables", "app_downloads", "signups", "ride_requests",
           "transactions", "reviews", "REVIEW_PHRASES"]
