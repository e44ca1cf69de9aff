"""Calendar parts and interval fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_parts(ts: str | Column, prefix: str = "") -> list[Column]:
    """``extract(year|month|hour FROM ts)`` as BIGINT columns named year/month/hour."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return [F.year(ts).cast("bigint").alias(prefix + "year"),
            F.month(ts).cast("bigint").alias(prefix + "month"),
            F.hour(ts).cast("bigint").alias(prefix + "hour")]


def time_parts_sql(ts: str) -> list[str]:
    """:func:`time_parts` of a column as SQL texts (one call into the JVM for all)."""
    return [f"CAST({part}({ts}) AS BIGINT) AS {part}" for part in ("year", "month", "hour")]


def minute_field_sql(later: str, earlier: str) -> str:
    """:func:`minute_field` of two columns as SQL text."""
    return f"CAST(extract(MINUTE FROM ({later} - {earlier})) AS BIGINT)"


def minute_field(later: str | Column, earlier: str | Column) -> Column:
    """``extract(minute FROM later - earlier)``: the signed 0-59 minute *field*
    of the day-time interval, not the elapsed minutes (75 min -> 15,
    -5.5 min -> -5). NULL when either side is NULL."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return F.extract(F.lit("MINUTE"), later - earlier).cast("bigint")
