"""Column types of a CSV found from its values, as a data frame reader would.

Every file is read once as text; each task keeps, per column, which kinds of value it saw,
and these are merged (a set union, so the order of files does not matter). The rules:
only whole numbers give BIGINT, whole numbers with missing values or any decimal numbers
DOUBLE, only true and false BOOLEAN, no value at all DOUBLE, everything else STRING;
whole numbers beyond 64 bits count as text (a reader that goes line by line lets their
place decide), and so do truth values with missing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.functions.text import sql_name
from ridelens.sources.csv import CSV_OPTIONS

# The texts that stand for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE, FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

_WHOLE = r"^ *[+-]?[0-9]+ *$"
_DECIMAL = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
KINDS = ("missing", "truth", "whole", "decimal", "text")


def read_csv_texts(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The CSV with every column as text; ``columns`` names them where files may hold no header."""
    reader = spark.read.options(**CSV_OPTIONS)
    if columns:
        reader = reader.schema(", ".join(f"{sql_name(c)} STRING" for c in columns))
    return reader.csv(path)


def _kind(value: Column) -> Column:
    """The bit of a text's place in ``KINDS``."""
    whole = value.rlike(_WHOLE)
    return (F.when(value.isNull() | value.isin(MISSING), 1 << 0).when(value.isin(TRUE + FALSE), 1 << 1)
            .when(whole & F.trim(value).try_cast("bigint").isNotNull(), 1 << 2).when(whole, 1 << 4)
            .when(value.rlike(_DECIMAL) | value.rlike(_INFINITE), 1 << 3).otherwise(1 << 4))


def kinds_seen(texts: DataFrame) -> DataFrame:
    """``column`` and one BOOLEAN per kind of value that occurs in it; one pass of the files."""
    seen = [F.coalesce(F.bit_or(_kind(F.col(sql_name(c)))), F.lit(0)).alias(f"_{i}")
            for i, c in enumerate(texts.columns)]
    if not seen:
        raise ValueError("a CSV without columns")
    row = texts.agg(*seen)
    entries = [F.struct(F.lit(c).alias("column"),
                        *[(F.col(f"_{i}").bitwiseAND(1 << k) != 0).alias(kind) for k, kind in enumerate(KINDS)])
               for i, c in enumerate(texts.columns)]
    return row.select(F.inline(F.array(*entries)))


def inferred_types(texts: DataFrame) -> DataFrame:
    """``column, type`` of every column of a frame of texts (STRING for one without rows)."""
    def only(*kinds: str) -> Column:
        return ~F.greatest(*[F.col(k) for k in KINDS if k not in kinds])

    return kinds_seen(texts).select("column", (
        F.when(only(), "string").when(only("missing"), "double").when(only("truth"), "boolean")
        .when(only("whole"), "bigint").when(only("missing", "whole", "decimal"), "double")
        .otherwise("string")).alias("type"))


def read_csv_inferred(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The CSV with the types its values have; missing values are NULL in every column."""
    texts = read_csv_texts(spark, path, columns)
    types = {r["column"]: r["type"] for r in inferred_types(texts).collect()}

    def typed(name: str) -> Column:
        text = F.col(sql_name(name))
        given = F.when(~text.isin(MISSING), text)
        if types[name] == "boolean":
            return given.isin(TRUE).alias(name)
        return (given if types[name] == "string" else F.trim(given).cast(types[name])).alias(name)

    return texts.select(*map(typed, texts.columns))
