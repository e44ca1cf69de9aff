"""Frame profile (rows, per-column non-null count and type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null, total`` - one aggregate pass, then unpivot."""
    counts = df.agg(F.count(F.lit(1)).alias("_total"),
                    *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(f.name).alias("column"),
                        F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"_nn{i}").cast("bigint").alias("non_null"),
                        F.col("_total").cast("bigint").alias("total"))
               for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*entries)))
