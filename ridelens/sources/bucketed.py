"""S1 stored for J4, J7 and J8: the ride-grain tables bucketed by ride.

Rides, transactions and reviews are joined and summed by ``ride_id`` in most queries. Stored
in equally many buckets of it, each of these joins and aggregates finds its rows where they
are, without a shuffle; only the join to the users is left to exchange anything. Worth it
for tables that are read often, as writing them shuffles each once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

RIDE_KEYED = ("ride_requests", "transactions", "reviews")


def _catalog_name(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def store_bucketed(tables: Mapping[str, DataFrame], buckets: int, prefix: str = "ridelens",
                   location: str | None = None, key: str = "ride_id", mode: str = "errorifexists") -> None:
    """Write the five tables to the warehouse (or below ``location``) as ``<prefix>_<name>``: those
    keyed by ride in ``buckets`` buckets sorted by it, the others as they are. One task
    writes one bucket, so there are no more files than buckets. ``buckets`` should give
    files of some 100 MB; a ride with very many rows makes its bucket larger (its joins
    are the matter of ``operators.skew``)."""
    for name, df in tables.items():
        keyed = name in RIDE_KEYED
        writer = (df.repartition(buckets, key) if keyed else df).write.mode(mode).format("parquet")
        if keyed:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        if location:
            writer = writer.option("path", f"{location}/{name}")
        writer.saveAsTable(_catalog_name(prefix, name))


def load_bucketed_tables(spark: SparkSession, names: tuple[str, ...],
                         prefix: str = "ridelens") -> dict[str, DataFrame]:
    """The tables that :func:`store_bucketed` wrote, by name; their buckets are used wherever a
    join or aggregate is by ride."""
    return {name: spark.table(_catalog_name(prefix, name)) for name in names}
