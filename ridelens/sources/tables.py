"""The five relational tables of the funnel, loaded by name."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("app_downloads", "signups", "ride_requests", "transactions", "reviews")


def dealt_out(df: DataFrame, name: str, partitions: Mapping[str, int] | None) -> DataFrame:
    """``df`` over the number of partitions the caller names for table ``name``, or as it is
    stored. For tables in too few row groups: a row group is read by one task, and what
    follows the scan (the text search over reviews) would run in that task too."""
    return df.repartition(partitions[name]) if partitions and name in partitions else df


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of the file system it names (S3, HDFS, local)."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def load_parquet_tables(spark: SparkSession, root: str, names: tuple[str, ...] = TABLE_NAMES,
                        partitions: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """One lazy Parquet scan per table (``<root>/<name>`` or ``<name>.parquet``), on any file
    system that Spark reads.

    Nothing is read here; column pruning and filters reach each scan later. ``partitions``
    deals tables out to that many tasks (:func:`dealt_out`).
    """
    tables = {}
    for name in names:
        path = os.path.join(root, name)
        if not path.endswith(".parquet") and _exists(spark, path + ".parquet"):
            path += ".parquet"
        tables[name] = dealt_out(spark.read.parquet(path), name, partitions)
    return tables


def load_jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str],
                     partitioning: dict[str, tuple[str, int, int, int]] | None = None,
                     names: tuple[str, ...] = TABLE_NAMES) -> dict[str, DataFrame]:
    """Tables from a database over JDBC.

    ``partitioning`` maps a table to ``(column, lower, upper, num_partitions)``
    so large tables are read by parallel range queries instead of one
    connection. Untested here: no database may be started in this environment.
    """
    partitioning = partitioning or {}
    tables = {}
    for name in names:
        if name in partitioning:
            column, lower, upper, parts = partitioning[name]
            tables[name] = spark.read.jdbc(url, name, column=column, lowerBound=lower,
                                           upperBound=upper, numPartitions=parts,
                                           properties=properties)
        else:
            tables[name] = spark.read.jdbc(url, name, properties=properties)
    return tables


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for every table, one global count each."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)
