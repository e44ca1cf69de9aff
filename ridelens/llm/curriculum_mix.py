"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words: the words of the whole corpus are
shared by source weight, a target stops at ``repeat_limit`` times its source's
size and the excess is reshared by weight until no target is above its limit
(a water level, found from one row per source).

Each source also has a weight *schedule* over training time [0, 1]: linear
pieces between knots. Its integral, scaled to the target, is the source's
cumulative word demand. The documents of a source stand in a fixed
pseudo-random order and are read as often as the target needs; a document whose
words begin at the cumulative count ``c`` gets the training position at which
the demand reaches ``c`` (the integral inverted piece by piece). ``arrange``
range-sorts the occurrences by position. The last reading of a source stops at
its target, so every source's taken words are its target rounded down.

Scale: the position of a document is a prefix sum over its source. Sources are
split into hash buckets of bounded size, so a source with a third of all rows
is many tasks: bucket totals first, then prefix sums inside each bucket.

Defined results: a NULL text has no words; a document without words takes
nothing and has no occurrence; a NULL source is a source of its own, ordered
last; a NULL id is ordered as ''; equal ids are ordered by their text; repeated
rows are documents of their own; no documents, no rows. Columns beside
``doc_id``, ``text`` and ``source`` are carried along unless they bear the name
of an output column, which replaces them.
"""

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import WORD, cut_lineage, text_of
from ridelens.session import written

WEIGHTS = (1, 2, 3)
REPEAT_LIMIT = 3
BUCKET_ROWS = 20_000
RANGE_BYTES = 64 << 20      # of texts in a range of the training order
# Weight over training time, by weight class: (time, weight) knots. Rising,
# steady and falling, so that the mix drifts from the third class to the first.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)),
             ((0.0, 1.0), (1.0, 1.0)),
             ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
OUTPUTS = ("size", "source_size", "target", "taken", "occurrences")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, repeat_limit: int = REPEAT_LIMIT) -> DataFrame:
    """Per source (one row each): source_size, class and target of ``sizes(source, size)``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("class", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = (ranked.withColumn("weight", F.element_at(cycle, F.col("class") + 1))
              .withColumn("most", F.col("source_size") * repeat_limit)
              .withColumn("ratio", F.col("most").cast("double") / F.col("weight")))
    # With the sources by ratio of limit to weight, those before the water level take
    # their limit; the level is what is left for the others per unit of weight.
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ranked = (ranked.withColumn("place", F.row_number().over(by_ratio))
              .withColumn("level", left.cast("double") / F.sum("weight").over(onward)))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    return ranked.withColumn("level", first["level"]).select(
        "source", "source_size", "class",
        F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def position(share: Column, schedule) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0..1) of its whole."""
    pieces, total = [], 0.0
    for (u, a), (v, b) in pairwise(schedule):
        pieces.append((u, a, (b - a) / (v - u), total))
        total += (a + b) / 2 * (v - u)
    found = None
    for u, a, slope, before in pieces:      # the last piece that begins at or below the share
        rest = share * total - before
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
        time = F.lit(u) + 2 * rest / (F.lit(a) + root)
        found = time if found is None else F.when(rest >= 0, time).otherwise(found)
    return found


def _sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """``carried`` with source, words and place in the order of its source of every document."""
    by_id = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(*carried, F.col("source"), n_words(text_of()).alias("size"), by_id.alias("by_id"),
                       F.md5(text_of().cast("binary")).alias("by_text"))


def _placed(small: DataFrame, sized: DataFrame, weights, repeat_limit: int, bucket_rows: int) -> DataFrame:
    """``sized`` with source_size, class, target and start: the words of its source before it;
    ``small`` has the source, size and by_id of the same documents, stored."""
    rows, digits = small.count(), 1
    while rows > bucket_rows * 16 ** digits:
        digits += 1
    bucket = F.substring("by_id", 1, digits)
    begins = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
               .withColumn("begin", F.coalesce(F.sum("words").over(begins), F.lit(0))))
    goals = targets(small, weights, repeat_limit)
    offsets = offsets.alias("o").join(
        goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("s"), F.col("bucket").alias("b"), "begin", "source_size",
        "class", "target")
    # as files its size is known: a small one is broadcast, and the documents shuffled once less
    offsets = written(offsets, "mix-offsets")
    placed = sized.withColumn("bucket", bucket)
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s"))
                         & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("s", "b").orderBy("by_id", "by_text").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.withColumn(
        "start", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def _read(placed: DataFrame, weights, schedules, repeat_limit: int) -> DataFrame:
    """``placed`` with taken and occurrences."""
    def occurrence(epoch):
        start = epoch * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("stop") - start))
        share = F.try_divide(start.cast("double"), F.col("target"))
        at = F.lit(None).cast("double")
        for k in range(len(weights)):
            at = F.when(F.col("class") == k, position(share, schedules[k % len(schedules)])) \
                .otherwise(at)
        return F.struct(epoch.alias("epoch"), words.cast("long").alias("words"), at.alias("position"))

    read = placed.withColumn("stop", F.floor("target").cast("long")).withColumn(
        "occurrences", F.filter(F.transform(
            F.array(*[F.lit(e) for e in range(repeat_limit)]), occurrence),
            lambda o: o["words"] > 0))
    return read.withColumn("taken", F.aggregate(F.transform("occurrences", lambda o: o["words"]),
                                                F.lit(0).cast("long"), lambda a, b: a + b))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, repeat_limit: int = REPEAT_LIMIT,
        bucket_rows: int = BUCKET_ROWS, columns: list[str] | None = None) -> DataFrame:
    """Each document with size, source_size, target, taken and its occurrences
    (epoch, words, position): which parts of the training stream it fills.

    ``columns`` are carried along (all if not given); the text travels only if it is one.
    """
    named = [c for c in columns or docs.columns if c.lower() not in OUTPUTS]
    small = cut_lineage(_sized(docs).drop("by_text"))
    placed = _placed(small, _sized(docs, F.struct(*named).alias("row")), weights, repeat_limit, bucket_rows)
    return _read(placed, weights, schedules, repeat_limit).select(
        "row.*", "size", "source_size", "target", "taken", "occurrences")


def arrange(mixed: DataFrame) -> DataFrame:
    """One row per occurrence (epoch, words, position added), range-sorted by position."""
    flat = mixed.select("*", F.explode("occurrences").alias("occurrence"))
    named = [c for c in mixed.columns if c.lower() not in ("epoch", "words", "position", "occurrences")]
    flat = flat.select(*named, "occurrence.*")
    return flat.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, repeat_limit: int = REPEAT_LIMIT,
                   bucket_rows: int = BUCKET_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of ``arrange(mix(docs))``; the texts are shuffled once.

    The positions are found and range-sorted without the texts. Inside a source and epoch
    they rise with the order by hashes of id and text, so a range holds one run of every
    source's documents. The runs' ends and the words before them tell each document, as it is
    read, the ranges of its readings; there its place follows from a prefix sum once more.
    Documents of equal id and text go to all ranges that any of them belongs to, and each
    is kept in its own.
    """
    named = [c for c in docs.columns if c.lower() not in OUTPUTS]
    key = F.unhex(F.concat("by_id", "by_text"))
    small = cut_lineage(_sized(docs, F.col("doc_id"), F.octet_length(text_of()).alias("bytes")))
    placed = _placed(small, small, weights, repeat_limit, bucket_rows)
    # a document's words begin at ``start``, those of the first one equal to it at ``base``
    equal = Window.partitionBy("s", "b", "by_id", "by_text")
    placed = placed.withColumn("base", F.min("start").over(equal)).withColumn("key", key)
    readings = cut_lineage(_read(placed, weights, schedules, repeat_limit).select(
        "doc_id", "source", "source_size", "class", "target", "key", "start", "base", "bytes",
        F.inline("occurrences")))
    n_ranges = 1 + (readings.agg(F.sum("bytes")).first()[0] or 0) // range_bytes
    ranged = readings.repartitionByRange(n_ranges, "position", "doc_id") \
        .withColumn("part", F.spark_partition_id())
    first_byte = lambda c: F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int")
    runs = ranged.groupBy("source", "epoch", "part").agg(
        *[F.first(c).alias(c) for c in ("source_size", "class", "target")],
        F.min("key").alias("low"), F.max("key").alias("high"), F.min("base").alias("base"),
        F.min("start").alias("first"), F.max("start").alias("last"))
    runs = written(runs.withColumnRenamed("source", "s").withColumn(
        "b", F.explode(F.sequence(first_byte("low"), first_byte("high")))), "mix-runs")
    n_parts = 1 + (runs.agg(F.max("part")).first()[0] or 0)

    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    texts = _sized(docs, F.struct(*named).alias("row"), F.xxhash64(*hashed).alias("tie")) \
        .withColumn("key", key).withColumn("bucket", first_byte("key"))
    texts = texts.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
                       & F.col("key").between(F.col("low"), F.col("high")))
    run = Window.partitionBy("part", "s", "epoch").orderBy("key", "tie").rowsBetween(
        Window.unboundedPreceding, -1)
    dealt = texts.select("row", "size", "tie", "key", "s", "epoch", "part", "source_size", "class", "target",
                         "base", "first", "last").repartitionById(n_parts, "part")
    dealt = dealt.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0))) \
        .where("size > 0 and start between first and last")
    read = _read(dealt, weights, schedules, repeat_limit).withColumn("occurrence", F.get(F.filter(
        "occurrences", lambda o: o["epoch"] == F.col("epoch")), F.lit(0)))
    columns = [c for c in named if c.lower() not in ("epoch", "words", "position")]
    return read.select(*[F.col("row")[c].alias(c) for c in columns], "size", "source_size", "target", "taken",
                       "occurrence.*").sortWithinPartitions("position", "doc_id")


def mix_report(docs: DataFrame, repeat_limit: int = REPEAT_LIMIT) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes."""
    return mix(docs, columns=["doc_id"], repeat_limit=repeat_limit).drop("occurrences")


def mix_positions(docs: DataFrame, repeat_limit: int = REPEAT_LIMIT) -> DataFrame:
    """The columns of :func:`mix_report` and the training position of each reading
    (``position_0`` and so on, NULL where it is not read), range-sorted by the first."""
    mixed = mix(docs, columns=["doc_id"], repeat_limit=repeat_limit)

    def reading(epoch: int) -> Column:
        found = F.filter("occurrences", lambda o: o["epoch"] == epoch)
        return F.get(found, F.lit(0))["position"].alias(f"position_{epoch}")

    found = mixed.select("doc_id", "size", "source_size", "target", "taken", *map(reading, range(repeat_limit)))
    return found.repartitionByRange("position_0", "doc_id").sortWithinPartitions("position_0", "doc_id")
