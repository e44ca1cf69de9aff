"""Review CSV files (header row, RFC-4180 quoting by doubling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Quoted fields may hold commas, doubled quotes and line breaks; multiLine
# keeps a quoted line break inside its record; blanks at either end are text.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# No text may equal the null marker, so it is one that text will not hold.
NULL_MARKER = "\u0000\u0001\u0000"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Distributed write, one file per partition (no coalesce to one task)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             empty_as_blank: list[str] | None = None) -> DataFrame:
    """Read with an explicit schema (no inference pass). Columns listed in
    ``empty_as_blank`` map a missing value back to ``''`` (labels are ``''``
    when absent, and a CSV cannot tell ``''`` from NULL everywhere)."""
    # The writer puts NULL as an empty field and '' as a quoted "": reading
    # with a null marker of control characters keeps the two apart (an unquoted
    # empty field still reads as NULL). Files from tools that write both as empty
    # (pandas) read as NULL, hence ``empty_as_blank``.
    df = spark.read.schema(schema).options(**CSV_OPTIONS, nullValue=NULL_MARKER).csv(path)
    if empty_as_blank:
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in empty_as_blank})
    return df
