"""Bitmap distinct counts: equal to count(DISTINCT) at any subset, mergeable, without gaps."""

import itertools

import pytest
from pyspark.sql import functions as F

from ridelens.operators import bitmaps
from ridelens.operators.ranking import numbered
from tests.conftest import canon

CELLS = ["platform", "year", "hour"]
COUNTED = {"all_rows": "true", "even": "n % 2 = 0"}


@pytest.fixture
def rows(spark):
    """Keys in many cells, one key with a third of the rows, NULL keys and NULL cells."""
    i = F.col("id")
    return spark.range(6000).select(
        F.when(i % 3 == 0, 7).when(i % 101 == 0, F.lit(None)).otherwise(i * 7919 % 100_003).alias("key"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), (i % 3).cast("string"))).alias("platform"),
        (2020 + i % 2).alias("year"), (i % 5).alias("hour"), i.alias("n"))


def expected(rows, keys):
    return rows.where("key IS NOT NULL").groupBy(*keys).agg(
        F.countDistinct("key").alias("all_rows"),
        F.countDistinct(F.expr("CASE WHEN n % 2 = 0 THEN key END")).alias("even"))


def test_every_subset_equals_count_distinct(rows):
    subsets = [list(s) for k in range(len(CELLS) + 1) for s in itertools.combinations(CELLS, k)]
    found = bitmaps.distinct_rollup(bitmaps.distinct_bitmaps(rows, "key", CELLS, COUNTED), CELLS,
                                    list(COUNTED), subsets).collect()
    assert {r.level for r in found} == {",".join(s) for s in subsets}
    for keys in subsets:
        got = [tuple(r[c] for c in [*keys, *COUNTED]) for r in found if r.level == ",".join(keys)]
        assert canon(got) == canon(expected(rows, keys).collect())


def test_numbers_are_dense_and_follow_the_cells(rows):
    numbers = bitmaps.key_numbers(rows, "key", ["platform"]).collect()
    keys = rows.where("key IS NOT NULL").select("key").distinct().count()
    assert sorted(r._number for r in numbers) == list(range(1, keys + 1))
    home = {r.key: r.p for r in rows.groupBy("key").agg(F.min(F.struct("platform")).alias("p")).collect()}
    order = [(home[r.key].platform is not None, home[r.key].platform or "", r.key)
             for r in sorted(numbers, key=lambda r: r._number)]
    assert order == sorted(order)


def test_later_keys_keep_earlier_bitmaps_valid(rows):
    """Bitmaps of two halves, numbered one after the other, merge to those of the whole."""
    old, new = rows.where("n < 3500"), rows.where("n >= 3500")
    first = bitmaps.key_numbers(old, "key")
    both = bitmaps.key_numbers(new, "key", known=first)
    kept = {r.key: r._number for r in first.collect()}
    assert kept.items() <= {r.key: r._number for r in both.collect()}.items()
    parts = [bitmaps.distinct_bitmaps(part, "key", CELLS, COUNTED, both) for part in (old, new)]
    union = parts[0].unionByName(parts[1])
    for keys in (CELLS, ["hour"], []):
        got = bitmaps.distinct_counts(union, keys, list(COUNTED))
        assert canon(got.collect()) == canon(expected(rows, keys).collect())


def test_buckets_hold_keys_beyond_one_bitmap(spark):
    rows = spark.range(100_000).selectExpr("id AS key", "id % 2 AS hour")
    maps = bitmaps.distinct_bitmaps(rows, "key", ["hour"], {"n": "true"})
    # numbers follow the cell: two cells of 50,000 keys lie in two or three buckets each
    assert maps.count() <= 5
    assert bitmaps.distinct_counts(maps, [], ["n"]).first().n == 100_000


def test_unknown_cell_is_refused(rows):
    maps = bitmaps.distinct_bitmaps(rows, "key", CELLS, COUNTED)
    with pytest.raises(ValueError, match="unknown cells"):
        bitmaps.distinct_rollup(maps, CELLS, list(COUNTED), [["age"]])


def test_places_are_exact_with_ties(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS v")
    found = numbered(rows, "v").orderBy("place").collect()
    assert [r.place for r in found] == list(range(5000))
    assert [r.v for r in found] == sorted(r.v for r in found)
    assert numbered(spark.range(0), "id").collect() == []
