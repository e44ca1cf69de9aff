"""Exact places of rows in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.session import stored

_ROW, _PART = "_row", "_part"


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with column ``name``: 0 for the first row by ``order``, 1 for the next and
    so on. ``rows`` must be the same whenever they are computed; rows equal in ``order``
    stand in the order they are stored in.

    A range sort gives each task a run of the order; one count per partition (all that
    comes to the driver) shifts its own numbering to the global one. The running number as last sort key deals out rows that
    are equal in ``order``. The sorted rows are kept in the checkpoint folder, so a task
    computed again cannot number them otherwise.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(_ROW)]
    ranged = rows.withColumn(_ROW, F.monotonically_increasing_id()) \
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_ROW)
    ranged = stored(ranged).select("*", F.spark_partition_id().alias(_PART),
                                   F.monotonically_increasing_id().alias(_ROW))
    runs = ranged.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"), F.min(_ROW).alias("first")).collect()
    found = {r[_PART]: r for r in runs}
    shifts, before = [], 0
    for part in range(max(found, default=0) + 1):
        shifts.append(before - found[part]["first"] if part in found else 0)
        before += found[part]["n"] if part in found else 0
    shift = F.expr(f"get(array({', '.join(f'{s}L' for s in shifts)}), {_PART})")
    return ranged.withColumn(name, F.col(_ROW) + shift).drop(_PART, _ROW)
