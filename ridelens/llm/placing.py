"""Exact places of rows in a sorted order, without a window over a whole group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` inside ``tree``) and ``size`` of the tree.

    ``rows`` must be the same whenever they are computed. A range sort deals a large
    tree out to many partitions (equal rows are told apart by a running number); one
    count per partition and tree then shifts the places inside a partition to those
    of the whole tree. The sorted rows are kept in the checkpoint folder, so a lost
    executor cannot change a place.
    """
    keys = ["tree", *order, "stored"]
    rows = rows.withColumn("stored", F.monotonically_increasing_id())
    rows = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("stored"))
    rows = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    runs = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return rows.join(runs, ["tree", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift")
