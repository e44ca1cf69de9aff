"""LEFT JOINs whose hot keys are split by the plan.

AQE splits a skewed partition only above a size (256 MB by default), only on the
preserved side of a LEFT JOIN, and not at all where an aggregate reuses the join's
partitioning. Here a pass over the keys finds the heavy ones first; only their rows are
salted, and only their matches are repeated, once per salt. Rows with a NULL key match
nothing, so they are not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.setops import union_all

_SALT, _COPIES, _KEY = "_salt", "_copies", "_heavy_key"


def heavy_keys(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``_heavy_key, _copies``: the keys on more rows than half a shuffle partition would hold if
    all were even, and the number of such halves each fills. There are at most twice as many
    as partitions, so they are fetched and handed back as a local table: Spark knows its
    size and broadcasts it, or drops the joins with it where no key is heavy."""
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(_KEY)).count()
    total = rows.where(F.col(key).isNotNull()).count()
    most = max(total / (2 * partitions), 1.0)
    found = counts.where(F.col("count") > most).select(_KEY, F.ceil(F.col("count") / most).cast("int").alias(_COPIES))
    return spark.createDataFrame(found.toArrow(), found.schema)


def _spread(rows: DataFrame, key: Column, heavy: DataFrame) -> DataFrame:
    """``rows`` with a salt: dealt over a heavy key's salts one after the other, else 0."""
    turn = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(_COPIES), F.lit(1)))
    return rows.join(heavy, key == F.col(_KEY), "left").withColumn(_SALT, turn.cast("int")).drop(_KEY, _COPIES)


def _repeated(rows: DataFrame, key: Column, heavy: DataFrame) -> DataFrame:
    """``rows`` once per salt of a heavy key, else once."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col(_COPIES), F.lit(1)) - 1)
    return rows.join(heavy, key == F.col(_KEY), "left").withColumn(_SALT, F.explode(salts)).drop(_KEY, _COPIES)


def split_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                    heavy_left: DataFrame | None = None, heavy_right: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key``; columns of ``left``, then those of
    ``right`` but its key (no other name may be in both).

    ``heavy_left`` and ``heavy_right`` (:func:`heavy_keys` of either side) name the keys to
    split; without either it is a plain LEFT JOIN that keeps NULL keys out of the shuffle.
    A key heavy on the right occurs there, so its rows match for sure and
    an inner join of them, with the left rows repeated, is exact.
    """
    others = [f for f in right.schema.fields if f.name != right_key]
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in others]
    columns = [*left.columns, *[f.name for f in others]]
    unmatched = left.where(F.col(left_key).isNull()).select(*left.columns, *blank)
    rows = left.where(F.col(left_key).isNotNull())
    parts = [unmatched]
    right = right.withColumnRenamed(right_key, "_right_key").where(F.col("_right_key").isNotNull())
    if heavy_right is not None:
        on_left, on_right = F.col(left_key) == F.col(_KEY), F.col("_right_key") == F.col(_KEY)
        hot = _repeated(rows.join(heavy_right, on_left, "left_semi"), F.col(left_key), heavy_right)
        hot_right = _spread(right.join(heavy_right, on_right, "left_semi"), F.col("_right_key"), heavy_right)
        met = (F.col(left_key) == F.col("_right_key")) & (hot[_SALT] == hot_right[_SALT])
        parts.append(hot.join(hot_right, met).select(*columns))
        rows = rows.join(heavy_right, on_left, "left_anti")
        right = right.join(heavy_right, on_right, "left_anti")
    if heavy_left is None:
        parts.append(rows.join(right, F.col(left_key) == F.col("_right_key"), "left").select(*columns))
    else:
        dealt, copies = _spread(rows, F.col(left_key), heavy_left), _repeated(right, F.col("_right_key"), heavy_left)
        met = (F.col(left_key) == F.col("_right_key")) & (dealt[_SALT] == copies[_SALT])
        parts.append(dealt.join(copies, met, "left").select(*columns))
    return union_all(parts)
