"""C6/X13 for dictionaries of any size: phrases as a table, joined to the texts.

An expression holds some hundred phrases; many thousands make a plan that no longer
compiles. Here the dictionary is a table. Each phrase is known by an anchor, the rarest
of its grams: runs of as many bytes as the largest of ``WIDTHS`` it holds, so an anchor is
half a phrase or more of up to 48 bytes and about as rare as the phrase. The anchors of a
text are joined to the phrases, and only phrases whose anchor a text holds are searched
in it, so a text meets little more than the phrases it contains.

Of a text's grams only those leave it that a bitmap of all anchors lets through (``BITS``
bits whatever the input, three per anchor): hashes with the text's row number, not the text.
Where the anchors are small Spark sends them to all tasks (their written size decides);
otherwise these few grams are shuffled. The texts are shuffled once, to the phrases to be
searched. Rarity is taken from a share of the texts; it and the bitmap only decide how many
candidates are tried, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.text import fold_case
from ridelens.session import stored, written

WIDTHS = (1, 2, 3, 4, 5, 8, 12, 24)     # bytes
SAMPLE_SHARE = 0.02
BITS = 2 ** 27
PROBES = 3
BLOCK = 2 ** 20                         # bytes of a text whose grams are held at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)


def width_of(size: int) -> int:
    """Bytes of the grams of a phrase of ``size`` bytes."""
    return max(w for w in WIDTHS if w <= size)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _hashes(block: np.ndarray, widths: Sequence[int]) -> Iterator[np.ndarray]:
    """The hash of every gram of each width: runs of 1, 2, 4 ... bytes put together."""
    runs, factors = [block.astype(np.uint64) + np.uint64(1)], [_BASE]
    while 2 ** len(runs) <= min(max(widths), len(block)):
        half, size = runs[-1], 2 ** (len(runs) - 1)
        runs.append(half[:-size] * factors[-1] + half[size:])
        factors.append(factors[-1] * factors[-1])
    for width in widths:
        n = len(block) - width + 1
        if n > 0:
            h, at = np.full(n, width, np.uint64), 0
            for k in range(len(runs)):
                if width >> k & 1:
                    h = h * factors[k] + runs[k][at:at + n]
                    at += 2 ** k
            yield _mixed(h)


def marked(h: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """The hashes whose probes are all set in the bitmap; all of them without one."""
    for probe in range(PROBES if bits is not None else 0):
        place = (h >> np.uint64(18 * probe)) & np.uint64(BITS - 1)
        h = h[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return h


def grams_of(body: bytes, widths: Sequence[int], bits: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """Hashes of the distinct grams of a text that the bitmap lets through."""
    data, found = np.frombuffer(body, np.uint8), [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for start in range(0, len(data), block):
            part = data[start:start + block + max(widths) - 1]
            found.append(np.unique(np.concatenate(
                [np.empty(0, np.uint64), *(marked(h, bits) for h in _hashes(part, widths))])))
    return np.unique(np.concatenate(found)).view(np.int64)


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap of the probes of ``grams(gram)``."""
    places = F.explode(F.array(*[F.shiftrightunsigned("gram", 18 * k).bitwiseAND(F.lit(BITS - 1))
                                 for k in range(PROBES)]))
    parts = grams.select(places.alias("place")).groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("bucket")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.bucket - 1) * len(part):r.bucket * len(part)] = part
    return bits


def marked_grams(texts: DataFrame, grams: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``_row, gram``: the distinct grams of each text that the bitmap of ``grams`` lets through."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(grams))
    widths = tuple(widths)

    @F.pandas_udf("array<bigint>")
    def find(bodies: pd.Series) -> pd.Series:
        return pd.Series([grams_of(b, widths, bits.value) for b in bodies])

    return texts.select("_row", F.explode(find(F.col("_text").cast("binary"))).alias("gram"))


def _anchors(phrases: DataFrame, texts: DataFrame, share: float) -> tuple[DataFrame, list[int]]:
    """``phrase, gram``: each phrase's rarest gram (ties go to the least), and the widths in use."""
    @F.pandas_udf("width int, grams array<bigint>")
    def split(bodies: pd.Series) -> pd.DataFrame:
        sizes = [width_of(len(b)) for b in bodies]
        return pd.DataFrame({"width": sizes, "grams": [grams_of(b, (w,)) for b, w in zip(bodies, sizes)]})

    grams = written(phrases.select("phrase", split(F.col("phrase").cast("binary")).alias("s")).select(
        "phrase", "s.width", F.explode("s.grams").alias("gram")), "phrase-grams")
    widths = sorted(r.width for r in grams.select("width").distinct().collect())   # as few as WIDTHS
    if not widths:
        return grams.select("phrase", "gram"), widths
    often = marked_grams(texts.sample(share, seed=17), grams, widths).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    rare = grams.join(often, "gram", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return written(rare.select("phrase", F.col("best.gram").alias("gram")), "anchors"), widths


def phrase_hits(texts: DataFrame, phrases: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """``_row, phrase`` for every phrase of ``phrases(phrase)`` that a text of
    ``texts(_row, _text)`` contains, as it is (no folding). Rows are numbered uniquely by
    the caller; NULL and empty phrases match nothing, repeated ones count once."""
    phrases = phrases.select("phrase").where(F.col("phrase") != "").distinct()
    texts = texts.where(F.col("_text").isNotNull())
    anchors, widths = _anchors(phrases, texts, share)
    if not widths:
        return texts.select("_row", F.lit("").alias("phrase")).limit(0)
    # written: the few grams are made once (in Python), and their size is known to the join
    found = written(marked_grams(texts, anchors, widths), "grams").join(anchors, "gram") \
        .groupBy("_row").agg(F.collect_set("phrase").alias("near"))
    checked = texts.join(found, "_row").select(
        "_row", F.explode(F.filter("near", lambda p: F.contains(F.col("_text"), p))).alias("phrase"))
    return checked


def numbered_texts(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` stored with a unique ``_row``; the text folded for search is ``_text``."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id())) \
        .withColumn("_text", fold_case(F.col(text_col)))


def flags_by_table(df: DataFrame, dictionary: DataFrame, text_col: str = "review") -> DataFrame:
    """C6 over a dictionary table ``(aspect, sentiment, phrase)``: one row per text of ``df``
    and entry flagged, with the columns of ``df``, ``aspect`` and ``sentiment``. Matching is
    that of ``keyword_flags`` for ASCII phrases: anywhere in the text, ignoring case."""
    rows = numbered_texts(df, text_col)
    entries = dictionary.select("aspect", "sentiment", F.lower("phrase").alias("phrase"))
    hits = phrase_hits(rows.select("_row", "_text").where(F.col("_text").isNotNull()), entries.select("phrase"))
    flagged = hits.join(entries.distinct(), "phrase").select("_row", "aspect", "sentiment").distinct()
    return rows.drop("_text").join(flagged, "_row").drop("_row")


def labels_by_table(df: DataFrame, dictionary: DataFrame, text_col: str = "review",
                    priority: Sequence[str] = ("positive", "satisfactory", "negative")) -> DataFrame:
    """C7 over a dictionary table: the columns of ``df`` with ``labels``, a map from each
    aspect flagged to its first sentiment by ``priority`` (sentiments not listed come last,
    by name); texts without a flag have an empty map."""
    rows = numbered_texts(df, text_col)
    entries = dictionary.select("aspect", "sentiment", F.lower("phrase").alias("phrase"))
    hits = phrase_hits(rows.select("_row", "_text").where(F.col("_text").isNotNull()), entries.select("phrase"))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("sentiment"))
    first = hits.join(entries.distinct(), "phrase").groupBy("_row", "aspect").agg(
        F.min(F.struct((place == 0).alias("other"), place.alias("place"), F.col("sentiment"))).alias("best"))
    labels = first.groupBy("_row").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("aspect", F.col("best.sentiment").alias("label"))))).alias("labels"))
    none = F.create_map().cast("map<string,string>")
    return rows.drop("_text").join(labels, "_row", "left").withColumn("labels", F.coalesce("labels", none)).drop("_row")


def phrase_counts(df: DataFrame, phrases: DataFrame, text_col: str = "review") -> DataFrame:
    """``phrase, n_texts``: how many texts of ``df`` contain each phrase, zero included. The
    texts are written folded, as Parquet, the phrases beside them."""
    rows = written(df.select(fold_case(F.col(text_col)).alias("_text")).where(F.col("_text").isNotNull())
                   .withColumn("_row", F.monotonically_increasing_id()), "texts")
    wanted = written(phrases.select(F.lower("phrase").alias("phrase")).where(F.col("phrase") != "").distinct(), "phrases")
    counts = phrase_hits(rows, wanted).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_texts"))
