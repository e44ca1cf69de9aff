"""Set operations: schema alignment, UNION (distinct), constant-row branches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ridelens.functions.text import sql_name


def align(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Project ``df`` onto ``schema``: present columns are cast, absent ones
    become typed NULLs, so branches of a set operation line up by name."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({sql_name(f.name) if f.name in present else 'NULL'} AS "
        f"{f.dataType.simpleString()}) AS {sql_name(f.name)}" for f in schema.fields])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """SQL ``UNION``: concatenation then duplicate removal, NULLs equal."""
    return union_all(frames).distinct()


def constant_row(source: DataFrame, *columns) -> DataFrame:
    """``SELECT <literals> FROM source UNION ...``: one row of literals if
    ``source`` has any row, none if it is empty. ``limit(1)`` stops after the
    first row instead of aggregating the whole table."""
    return source.limit(1).select(*columns)
