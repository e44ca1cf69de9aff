"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set if it is set in over half of the 64-bit
hashes of its word shingles. Documents whose fingerprints differ in at most
``max_bits`` bits are linked; classes are the connected components.

Only distinct fingerprints are compared, so exact copies cost nothing. The
fingerprint is cut into ``max_bits + 1`` blocks; a linked pair agrees in one of
them, so each fingerprint stands in that many indexes, each rotated to bring
another block to the front. An index is dealt out by the leading bits. Inside a
part the rotated fingerprints are sorted by Gray rank, and runs of equal leading
bits become nodes, level below level, each node holding the bit pattern its
members share under the level's mask. Pairs of nodes are compared from the top;
the differences add up on the way down and a pair of whole groups is dropped as
soon as they exceed ``max_bits``. A part returns a spanning forest of its links,
never all pairs.

A part with more than ``part_rows`` fingerprints (a dense cloud of near copies)
goes another exact way: two values are within two bits if and only if some value
is within one bit of both, so every fingerprint is sent to itself and its 64
neighbours and those that meet are linked. At most 65 can meet, whatever the
cloud's size. (``max_bits`` up to 2; larger distances keep to the index.)

Defined results: a NULL or empty text, or one of blanks only, has fingerprint
zero, linked like any other; fewer words than a shingle give one shingle of all;
texts are read in blocks, so length is not limited; repeated rows are rows of
their own with equal results; a NULL id counts for nothing in a component's
least id, which is NULL where no member has an id; no documents, no rows.
"""

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ridelens.llm.common import cut_lineage, free_name
from ridelens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BLOCK_BYTES = 1 << 20
TARGET_ROWS = 4_000
PART_ROWS = 60_000
LEVEL_BITS = 8
PAIRS_AT_ONCE = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(body: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words in order, about ``BLOCK_BYTES`` of text at a time.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z, and exactly the six
    blanks that part words.
    """
    at = 0
    while at < len(body):
        end = _BLANK.search(body, at + BLOCK_BYTES) if len(body) - at > BLOCK_BYTES else None
        stop = end.start() if end else len(body)
        yield body[at:stop].lower().split()
        at = stop


def fingerprint(body: bytes, n: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for block in _word_blocks(body):
        words = carried + block
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
        carried = words[-(n - 1):] if n > 1 else []
        if shingles:
            hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(shingles)
    if total == 0:
        return xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    set_bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""
    @F.pandas_udf("long")
    def prints(bodies: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(b, n) for b in bodies), np.uint64, len(bodies))
        return pd.Series(found.view(np.int64))

    return prints(F.coalesce(text, F.lit("")).cast("binary"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the binary-reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def close_pairs(values: np.ndarray, lead: int, max_bits: int):
    """Yield arrays (i, j) of positions in ``values`` (distinct, by Gray rank) of pairs
    with equal ``lead`` leading bits and at most ``max_bits`` differing bits."""
    ends = [lead, *range(lead + LEVEL_BITS, 64, LEVEL_BITS), 64]
    firsts = []
    for end in ends:
        prefix = values >> np.uint64(64 - end)
        firsts.append(np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))))
    # children of node i of a level: kids[i] .. kids[i + 1] of the next level
    kids = [np.append(np.searchsorted(below, above), len(below))
            for above, below in zip(firsts, firsts[1:])]
    masks = [np.uint64((1 << (64 - a)) - (1 << (64 - b))) for a, b in zip(ends, ends[1:])]

    size = np.diff(np.append(firsts[0], len(values)))
    roots = np.flatnonzero(size > 1)
    todo = [(0, roots, roots, np.zeros(len(roots), np.int64))]
    while todo:
        level, x, y, diff = todo.pop()
        if level == len(ends) - 1:
            yield firsts[level][x], firsts[level][y]
            continue
        below = kids[level]
        nx, ny = below[x + 1] - below[x], below[y + 1] - below[y]
        each = nx * ny
        if each.sum() > PAIRS_AT_ONCE and len(x) > 1:
            half = len(x) // 2
            todo += [(level, x[:half], y[:half], diff[:half]), (level, x[half:], y[half:], diff[half:])]
            continue
        origin = np.repeat(np.arange(len(x)), each)
        place = np.arange(len(origin)) - np.repeat(np.cumsum(each) - each, each)
        u = below[x][origin] + place // ny[origin]
        v = below[y][origin] + place % ny[origin]
        at = firsts[level + 1]
        total = diff[origin] + np.bitwise_count(
            (values[at[u]] ^ values[at[v]]) & masks[level]).astype(np.int64)
        keep = (u <= v) & (total <= max_bits)
        if level + 1 == len(ends) - 1:
            keep &= u < v
        if keep.any():
            todo.append((level + 1, u[keep], v[keep], total[keep]))


def forest(n: int, pairs) -> np.ndarray:
    """Least position reachable from each of ``n`` positions over the given pair arrays."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, before[a], least)
            np.minimum.at(root, before[b], least)
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            while (root[root] != root).any():
                root = root[root]
            if (root[a] == root[b]).all():
                break
    return root


def _rotated(name: str, by: int) -> Column:
    if by == 0:
        return F.col(name)
    return F.shiftleft(name, by).bitwiseOR(F.shiftrightunsigned(name, 64 - by))


def links(prints: DataFrame, max_bits: int = MAX_BITS, target_rows: int = TARGET_ROWS,
          part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``prints(fp)`` whose connected
    components are those of all pairs within ``max_bits`` bits."""
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    blocks = max_bits + 1
    lead = 64 // blocks
    turns = [round(i * 64 / blocks) for i in range(blocks)]
    deal = min(lead, max(0, math.ceil(math.log2(max(1, prints.count() / target_rows)))))
    placed = prints.select("fp", F.posexplode(F.array(*[_rotated("fp", t) for t in turns]))
                           .alias("turn", "value"))
    placed = placed.withColumn(
        "part", F.shiftrightunsigned("value", 64 - deal) if deal else F.lit(0).cast("long"))
    dense = None
    if max_bits <= 2:
        dense = placed.groupBy("turn", "part").count().where(F.col("count") > part_rows) \
            .select("turn", "part")
        crowded = placed.join(dense, ["turn", "part"], "left_semi").select("fp").distinct()
        placed = placed.join(dense, ["turn", "part"], "left_anti")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        values = part["value"].to_numpy().view(np.uint64)
        order = np.argsort(gray_rank(values))
        root = forest(len(order), close_pairs(values[order], lead, max_bits))
        own = part["fp"].to_numpy()[order]
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": own[linked], "b": own[root[linked]]})

    found = placed.groupBy("turn", "part").applyInPandas(search, "a long, b long")
    if dense is not None:
        found = found.union(_ball_links(crowded, 1 if max_bits == 2 else 0))
    return found


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints that share a value within ``radius`` (0 or 1) of both.

    With radius 1 these are the pairs within two bits. For one bit, the pair
    itself differs by a flip: only the two end points are compared.
    """
    flips = [F.lit(0).cast("long")] + [F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]
    ball = prints.select("fp", F.explode(F.transform(F.array(*flips), lambda m: m.bitwiseXOR(F.col("fp"))))
                         .alias("value"))
    if radius == 0:
        near = ball.where(F.col("value") != F.col("fp"))
        return near.join(prints.select(F.col("fp").alias("value")), "value").select(
            F.col("fp").alias("a"), F.col("value").alias("b"))
    met = ball.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **limits) -> DataFrame:
    """(doc_id, fp, label, component_id) per row of ``docs``; fp is a signed number and
    label one fingerprint of the class."""
    prints = cut_lineage(docs.select("doc_id", fingerprint_column(F.col("text"), n).alias("fp")))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), max_bits, **limits))
    labelled = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .withColumn("label", F.coalesce("root", "fp"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "label").select("fp", "label", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    **limits) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id reachable) per row."""
    return classes(docs, n, max_bits, **limits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **limits) -> DataFrame:
    """One row of ``docs`` per class, all columns kept: the row with the least id (a NULL
    id only where the class has no other)."""
    found = cut_lineage(classes(docs, n, max_bits, **limits))
    own, fp = free_name(docs, "first_id"), free_name(docs, "fp")
    rows, ids = found.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        first = found.where("doc_id = component_id").select(F.col("doc_id").alias(own))
        return docs.join(first, docs["doc_id"] == first[own], "left_semi")
    # Repeated or NULL ids: rows are told apart by their fingerprints as well.
    first = found.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("least"))
    first = first.select(F.col("least.doc_id").alias(own), F.col("least.fp").alias(fp + "_"))
    printed = docs.withColumn(fp, fingerprint_column(F.col("text"), n))
    kept = printed.join(first, printed["doc_id"].eqNullSafe(first[own])
                        & (printed[fp] == first[fp + "_"]), "left_semi")
    return kept.dropDuplicates(["doc_id", fp]).drop(fp)
