"""A1/A2 as mergeable bitmaps: exact distinct counts that roll up to any segments.

``count(DISTINCT id)`` per hour cannot be added up to days or platforms: the same user
is in several cells. A bitmap per cell can: the keys get dense numbers, each cell keeps
a bit per number, and the cells of any coarser grouping are OR-ed and their bits
counted. The rows are read and shuffled once; each further grouping reads bitmaps only.

Bits are kept in buckets of 32,768 (Spark's bitmap functions), one row per cell and
bucket, so no bitmap grows with the table, and a cell with most of the keys is many
rows. Numbers follow the cells' order, so the keys of a cell that holds them alone
are neighbours and share few buckets. A key with a third of all rows is collapsed per
(key, cell) before anything is joined.

Of very fine cells most bitmaps would hold a key or two in 32,768 bits. Such cells are kept
as members, one row per cell and number (``distinct_members``), never more than the rows;
bitmaps are made of them at the grouping asked for (``member_counts``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.text import sql_name
from ridelens.operators.ranking import numbered
from ridelens.operators.setops import union_all
from ridelens.session import stored

NUMBER = "_number"
BUCKET = "bucket"


def new_numbers(keys: DataFrame, key: str, order: Sequence[str] = (),
                known: DataFrame | None = None) -> DataFrame:
    """``key, _number``: distinct keys that are not ``known``, numbered after those without
    gaps, by ``order`` (the least of each key's values) and then the key."""
    homes = keys.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(*[F.col(c) for c in order], F.lit(0).alias("_"))).alias("_home"))
    first = 1
    if known is not None:
        homes = homes.join(known.select(key), key, "left_anti")
        first = (known.agg(F.max(NUMBER)).first()[0] or 0) + 1
    return numbered(homes, "_home", key, name="_place").select(key, (F.col("_place") + first).alias(NUMBER))


def key_numbers(keys: DataFrame, key: str, order: Sequence[str] = (),
                known: DataFrame | None = None) -> DataFrame:
    """``key, _number``: distinct keys numbered from 1 without gaps, by ``order`` (the least
    of each key's values) and then the key. ``known`` numbers are kept, and new keys
    numbered after them, so bitmaps made earlier stay valid."""
    new = new_numbers(keys, key, order, known)
    return new if known is None else known.select(key, NUMBER).unionByName(new)


def distinct_bitmaps(rows: DataFrame, key: str, cells: Sequence[str], counted: Mapping[str, str],
                     numbers: DataFrame | None = None) -> DataFrame:
    """``*cells, bucket`` and one bitmap per name in ``counted`` (name -> SQL condition): the
    keys with a row in the cell for which the condition holds. NULL keys count nowhere, as
    in ``count(DISTINCT)``; a cell without keys has no row. ``numbers`` are those of
    :func:`key_numbers`; by default the keys of ``rows`` are numbered."""
    flags = [F.max(F.expr(f"CAST({cond} AS INT)")).alias(name) for name, cond in counted.items()]
    per_key = stored(rows.where(F.col(key).isNotNull()).groupBy(key, *cells).agg(*flags))
    if numbers is None:
        numbers = key_numbers(per_key, key, cells)
    number = sql_name(NUMBER)
    found = per_key.join(numbers.select(key, NUMBER), key).groupBy(
        *cells, F.expr(f"bitmap_bucket_number({number})").alias(BUCKET))
    return found.agg(*[F.expr(f"bitmap_construct_agg(CASE WHEN {sql_name(name)} = 1 THEN "
                              f"bitmap_bit_position({number}) END)").alias(name) for name in counted])


def distinct_members(rows: DataFrame, key: str, cells: Sequence[str], counted: Mapping[str, str],
                     numbers: DataFrame) -> DataFrame:
    """``*cells, _number`` and a flag per name in ``counted`` (name -> SQL condition): the keys
    with a row in the cell, each once, and whether the condition holds for any such row. NULL
    keys have no row."""
    flags = [F.max(F.coalesce(F.expr(cond), F.lit(False))).alias(name) for name, cond in counted.items()]
    per_key = rows.where(F.col(key).isNotNull()).groupBy(key, *cells).agg(*flags)
    return per_key.join(numbers.select(key, NUMBER), key).select(*cells, NUMBER, *counted)


def member_counts(members: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``*keys`` and the distinct count behind each flag of :func:`distinct_members` rows, at
    any subset of the cells. The members are shuffled, a bucket to one task, and the bitmaps
    made and counted there."""
    number = sql_name(NUMBER)
    placed = members.withColumn(BUCKET, F.expr(f"bitmap_bucket_number({number})")).repartition(*keys, BUCKET)
    maps = placed.groupBy(*keys, BUCKET).agg(
        *[F.expr(f"bitmap_construct_agg(CASE WHEN {sql_name(n)} THEN bitmap_bit_position({number}) END)").alias(n)
          for n in names])
    return maps.groupBy(*keys).agg(*[F.coalesce(F.sum(F.expr(f"bitmap_count({sql_name(n)})")), F.lit(0))
                                     .cast("bigint").alias(n) for n in names])


def merged(bitmaps: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Bitmaps of the coarser cells ``keys``: an OR of the finer ones, bucket by bucket."""
    return bitmaps.groupBy(*keys, BUCKET).agg(
        *[F.expr(f"bitmap_or_agg({sql_name(n)})").alias(n) for n in names])


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``*keys`` and the distinct count behind each bitmap, at any subset of the cells."""
    return merged(bitmaps, keys, names).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.expr(f"bitmap_count({sql_name(n)})")), F.lit(0)).cast("bigint").alias(n)
          for n in names])


def distinct_rollup(bitmaps: DataFrame, cells: Sequence[str], names: Sequence[str],
                    subsets: Sequence[Sequence[str]]) -> DataFrame:
    """``level, *cells, *names``: the counts for every subset of the cells asked for; cells
    outside a subset are NULL and ``level`` names those inside, joined by commas. The
    bitmaps are built once and kept; every subset reads only them."""
    bitmaps = stored(bitmaps)
    parts = []
    for keys in subsets:
        unknown = set(keys) - set(cells)
        if unknown:
            raise ValueError(f"unknown cells {sorted(unknown)}; use {list(cells)}")
        types = {f.name: f.dataType for f in bitmaps.schema.fields}
        counts = distinct_counts(bitmaps, keys, names)
        parts.append(counts.select(
            F.lit(",".join(keys)).alias("level"),
            *[F.col(c) if c in keys else F.lit(None).cast(types[c]).alias(c) for c in cells], *names))
    return union_all(parts)
