"""Reproducible random sample of reviews (ORDER BY random() LIMIT n).

The random order is a hash order - md5 of a seed and all of the review's
columns, so that the reviews of one ride or user are drawn one by one - and a
recomputed partition after executor loss yields the same rows, and DuckDB can
reproduce the sample exactly. Equal reviews share a key; a table with a review
id can name it as ``key_cols`` instead.

At scale a plain ``orderBy(key).limit(n)`` over reviews joined to rides would
shuffle the whole rides table and make every task send its own top n to one
final task (tasks x n rows). Instead:

1. md5 keys are spread evenly, so a share slightly above n / N of their range holds n
   reviews (nearly always; if not, a wider share is taken). One pass over the texts
   makes the keys and stores the reviews in that share with them;
2. only the rides of those candidates are joined (a semi join on the candidate
   ride ids, which AQE broadcasts if they measure small);
3. the exact top n is taken over the joined candidates: by a sort and limit in one task
   for samples of some ten thousand (:func:`review_sample`), or for samples of any
   size by exact places from a range sort, where no task holds the sample
   (:func:`ranked_review_sample`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions.time import time_parts
from ridelens.operators.ranking import numbered
from ridelens.session import stored, written

REFERENCE_SAMPLE_SIZE = 49999
SAMPLE_COLUMNS = ["user_id", "year", "month", "hour", "rating", "review"]
TIE_BREAK = ["year", "month", "hour", "rating", "review"]
KEY_COLUMNS = ["ride_id", "user_id", "rating", "review"]
_PREFIX_HEX = 8                     # leading hex digits of a key that a share is cut at


def sample_key(seed: str | int, *cols: str) -> Column:
    """``md5(concat_ws('|', seed, col1, col2, ...))`` as lower-case hex."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_candidates(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of ``df`` with the n least keys and some more, written, so that the keys are made
    in one pass; ``df`` itself where it has no more than n rows."""
    total = df.count()
    spare = n + 8 * math.sqrt(n) + 16
    while spare < total:
        least = f"{int(spare / total * 16 ** _PREFIX_HEX):0{_PREFIX_HEX}x}"
        # (the same condition again over what is stored: Spark takes it as selective, so
        # its runtime filters may prune what is joined to the candidates)
        near = F.substring(F.col(key), 1, _PREFIX_HEX) <= F.lit(least)
        found = written(df.where(near), "sample-candidates").where(near)
        if found.count() >= n:
            return found
        spare *= 4          # many equal keys stand further up
    return df


def top_n_by_key(df: DataFrame, n: int, key: str, tie_break: list[str]) -> DataFrame:
    """The n rows with the smallest ``key`` (then ``tie_break``, NULLs first)."""
    order = [F.col(key)] + [F.col(c).asc_nulls_first() for c in tie_break]
    return df.orderBy(*order).limit(n)


def reviews_for_sample(reviews: DataFrame, rides: DataFrame, seed: str | int,
                       key_cols: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """reviews LEFT JOIN rides with request calendar parts and the sample key."""
    r = rides.select("ride_id", "request_ts")
    return reviews.join(r, "ride_id", "left").select(
        "user_id", *time_parts("request_ts"), "rating", "review",
        sample_key(seed, *key_cols).alias("_key"))


def _joined_candidates(reviews: DataFrame, rides: DataFrame, n: int, seed: str | int,
                       key_cols: Sequence[str]) -> DataFrame:
    """The reviews whose keys are among the n least (and some more) with their rides' time."""
    keyed = reviews.select("ride_id", "user_id", "rating", "review",
                           sample_key(seed, *key_cols).alias("_key"))
    # Every review gives at least one joined row with its own key, so n
    # candidate reviews hold the n smallest keys of the joined rows too.
    candidates = hash_candidates(keyed, n, "_key")
    r = rides.select("ride_id", "request_ts")
    if candidates is not keyed:
        r = r.join(candidates.select("ride_id"), "ride_id", "left_semi")
    return candidates.join(r, "ride_id", "left").select(
        "user_id", *time_parts("request_ts"), "rating", "review", "_key")


def review_sample(reviews: DataFrame, rides: DataFrame, n: int = REFERENCE_SAMPLE_SIZE,
                  seed: str | int = 42, key_cols: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """``user_id, year, month, hour, rating, review`` for min(n, N) reviews of
    reviews LEFT JOIN rides, in hash order of ``key_cols``."""
    joined = _joined_candidates(reviews, rides, n, seed, key_cols)
    return top_n_by_key(joined, n, "_key", TIE_BREAK).select(*SAMPLE_COLUMNS)


def ranked_review_sample(reviews: DataFrame, rides: DataFrame, n: int, seed: str | int = 42,
                         key_cols: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """``place`` (from 0) and the columns of :func:`review_sample`: the same reviews, for
    samples too large for one task. The candidates are range-sorted by key, counted per
    partition, and cut at n inside the one partition that n falls in."""
    joined = _joined_candidates(reviews, rides, n, seed, key_cols)
    order = ["_key", *TIE_BREAK]          # range sorts put NULLs first, as the tie break does
    return numbered(stored(joined), *order).where(F.col("place") < n).select("place", *SAMPLE_COLUMNS)
