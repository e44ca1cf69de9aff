"""C3/C4 by increments: new rides are added without computing the old ones again.

A store keeps, per batch of rides, what merges exactly: counts and sums per day and segment,
and the riders and rides there that reached each stage, as numbers (``operators.bitmaps``, so
that distinct counts merge too): a segment's day has few of all riders, and a bitmap each
would be mostly empty, so bitmaps are made when a result is asked for. A result at any subset of the segments reads only these
partials. A batch may hold late rides of any day; a batch that is run again replaces its
own partials, so reruns add nothing. A ride belongs to one batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.functions.numeric import ratio
from ridelens.functions.time import minute_field_sql, time_parts
from ridelens.operators import bitmaps
from ridelens.operators.joins import enrich_rides
from ridelens.operators.segments import SEGMENT_KEYS, check_keys
from ridelens.session import stored

DAY = "day"
CELLS = [*SEGMENT_KEYS, DAY]
DONE = "accept_ts IS NOT NULL AND dropoff_ts IS NOT NULL"
REACHED = {"requested": "true", "accepted": "accept_ts IS NOT NULL", "completed": DONE}
MINUTES = {
    "requested_cancelled": minute_field_sql("cancel_ts", "request_ts"),
    "requested_accepted": minute_field_sql("accept_ts", "request_ts"),
    "accepted_pickup": minute_field_sql("pickup_ts", "accept_ts"),
    "ride_duration": f"CASE WHEN {DONE} THEN {minute_field_sql('dropoff_ts', 'pickup_ts')} END",
}
GRAINS = {"users": "user_id", "rides": "ride_id"}
USED = ["user_id", "ride_id", "platform", "age_range",
        "request_ts", "accept_ts", "pickup_ts", "dropoff_ts", "cancel_ts"]
SUMS = ["ride_rows", "cancelled", *[f"{m}_{k}" for m in MINUTES for k in ("sum", "n")]]


class PartialStore:
    """Partials of rides under ``path`` (any file system that Spark writes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.path}/{name}") if files.exists(folder) else None

    def _replace(self, name: str, batch: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def add(self, batch: str, t: Mapping[str, DataFrame]) -> None:
        """Partials of the rides in ``t``, in place of any that ``batch`` has already."""
        rides = enrich_rides(t["ride_requests"], t["signups"], t["app_downloads"])
        rows = stored(rides.select(*USED, *time_parts("request_ts"), F.to_date("request_ts").alias(DAY)))
        minutes = [F.expr(f"{how}({sql})").alias(f"{name}_{end}") for name, sql in MINUTES.items()
                   for how, end in (("sum", "sum"), ("count", "n"))]
        self._replace("sums", batch, rows.groupBy(*CELLS).agg(
            F.count(F.lit(1)).alias("ride_rows"), F.count("cancel_ts").alias("cancelled"), *minutes))
        for grain, key in GRAINS.items():
            # numbers are only ever added: those of an earlier run of the batch hold
            bitmaps.new_numbers(rows, key, CELLS, self._read(f"{grain}_numbers")) \
                .write.mode("append").parquet(f"{self.path}/{grain}_numbers")
            numbers = self._read(f"{grain}_numbers")
            self._replace(f"{grain}_members", batch, bitmaps.distinct_members(rows, key, CELLS, REACHED, numbers))

    def extract(self, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
        """Per segment: riders and rides that reached each stage, cancellation rate and mean
        minutes, merged from all batches."""
        check_keys(keys)
        sums = self._read("sums").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
        found = sums
        for grain in GRAINS:
            counts = stored(bitmaps.member_counts(self._read(f"{grain}_members"), keys, list(REACHED)))
            counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys],
                                   *[F.col(n).alias(f"{grain}_{n}") for n in REACHED])
            met = F.lit(True)
            for k in keys:
                met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
            found = found.join(counts, met, "left").drop(*[f"_{k}" for k in keys])
        reached = [F.coalesce(f"{g}_{n}", F.lit(0)).cast("bigint").alias(f"{g}_{n}") for g in GRAINS for n in REACHED]
        means = [ratio(F.col(f"{m}_sum"), F.col(f"{m}_n")).alias(f"avg_{m}") for m in MINUTES]
        return found.select(*keys, *reached, F.col("ride_rows").cast("bigint").alias("ride_rows"),
                            ratio(F.col("cancelled"), F.col("ride_rows")).alias("cancelled_share"), *means)
