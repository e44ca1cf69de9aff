"""Benchmark decontamination by q-gram counting and banded alignment.

A document leaks a benchmark item if some stretch of its text turns into the
item's text within an edit budget of ``EDIT_RATE`` of the item's characters
(case of A-Z and kind of blank do not count).

An item of n characters and budget e shares at least ``n + 1 - q - q e``
character q-grams with such a stretch (q-gram lemma), all of them on diagonals
(place in the text minus place in the item) at most e apart. Shared q-grams are
therefore counted in overlapping bands of diagonals, each band 2 (e + 1) wide
and each next one e + 1 further, so that any leak lies whole in one band. Bands
that reach the bound are aligned: the item against the band's region, with
free ends in the text and a band as wide as the diagonals allow.

The benchmark is the stated query set: it is read to the driver block by block
(``BLOCK_CHARS`` characters), and every block is broadcast as an index of its
q-grams; its size is bounded by the block, not by the table. The documents are
scanned once per block and never shuffled; long texts are read in overlapping
windows.

Defined results: NULL, empty and blank items match nothing; an item shorter
than q is looked for as it is; a budget too large for the lemma (short items) is
lowered until the bound is one shared q-gram; a NULL or empty text leaks
nothing; each leak reports its place and distance, the best of overlapping
alignments, ties to the earlier place; repeated rows and items give repeated
results; an empty table on either side gives no leak.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import free_name

Q = 8                       # a power of two
EDIT_RATE = 0.1
BLOCK_CHARS = 1 << 20
WINDOW_CHARS = 1 << 20
HITS = "array<struct<item_id:bigint,start:int,stop:int,distance:int>>"


def folded(text: str) -> np.ndarray:
    """Code points with A-Z in lower case and the blanks TAB..CR as spaces; same length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place, by doubling its length."""
    h, width, base = codes.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < Q and len(h) > width:
        h = h[:-width] * np.uint64(base) + h[width:]
        h ^= h >> np.uint64(29)
        base = base * base % 2 ** 64
        width *= 2
    return h if width == Q else h[:0]


def budget(n: int) -> tuple[int, int]:
    """Edit budget of an item of ``n`` characters and its bound of shared q-grams."""
    edits = max(0, min(int(EDIT_RATE * n), (n - Q) // Q))
    return edits, n + 1 - Q - Q * edits


@dataclass
class Index:
    """The q-grams of a block of items: sorted hashes and, by hash, (item, place)."""

    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)

    def build(self) -> "Index":
        grams = [gram_hashes(t) for t in self.texts]
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        bits = max(10, int(np.ceil(np.log2(16 * max(1, len(self.keys))))))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys >> self.shift] = True
        plan = [budget(len(t)) for t in self.texts]
        self.edits = np.array([e for e, _ in plan], np.int64)
        self.bound = np.array([b for _, b in plan], np.int64)
        self.short = [i for i, t in enumerate(self.texts) if len(t) < Q]
        self.stride = max(map(len, self.texts), default=1)
        self.longest = max((len(t) + e for t, (e, _) in zip(self.texts, plan)), default=0)
        return self


def candidates(codes: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(item, first, last diagonal) of the bands that reach their item's bound."""
    hashes = gram_hashes(codes)
    at = np.flatnonzero(index.maybe[hashes >> index.shift])
    if not len(at):
        return
    key = np.searchsorted(index.keys, hashes[at])
    key[key == len(index.keys)] = 0
    exact = index.keys[key] == hashes[at]
    at, key = at[exact], key[exact]
    each = index.first[key + 1] - index.first[key]
    source = np.repeat(np.arange(len(at)), each)
    posting = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each) + index.first[key][source]
    item = index.item[posting].astype(np.int64)
    # an upper bound first: items with too few shared q-grams in the whole text
    enough = np.bincount(item, minlength=len(index.bound)) >= index.bound
    keep = enough[item]
    item, place = item[keep], index.place[posting[keep]]
    diagonal = at[source[keep]] - place
    if not len(item):
        return
    step = index.edits[item] + 1
    band = diagonal // step
    lowest = band.min() - 1
    width = band.max() - lowest + 1
    # a diagonal lies in the band that begins at its own step and in the one before
    code = np.concatenate([item * width + band - lowest, item * width + band - 1 - lowest])
    codes_met, which, count = np.unique(code, return_inverse=True, return_counts=True)
    full = (count >= index.bound[codes_met // width])[which]
    if not full.any():
        return
    # each of the item's q-grams counts once, however often the band repeats it
    once = np.unique(code[full] * index.stride + np.concatenate([place, place])[full])
    code, count = np.unique(once // index.stride, return_counts=True)
    item, band = code // width, code % width + lowest
    for i, b in zip(*(x[count >= index.bound[item]] for x in (item, band))):
        size = index.edits[i] + 1
        yield int(i), int(b * size), int((b + 2) * size - 1)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits that turn a stretch of ``region`` into ``item`` and the stretch's end,
    with cell (i, j) kept only where ``low <= j - i <= high``; None if over ``most``."""
    width = high - low + 1
    offsets = np.arange(width)
    far = len(item) + len(region) + 1
    columns = low + offsets                                # j for i = 0
    row = np.where((columns >= 0) & (columns <= len(region)), 0, far)
    for i in range(1, len(item) + 1):
        columns = columns + 1
        valid = (columns >= 1) & (columns <= len(region))
        letters = region[np.clip(columns - 1, 0, max(0, len(region) - 1))]
        best = np.where(valid, row + (letters != item[i - 1]), far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)     # a letter of the item left out
        best[(columns < 0) | (columns > len(region))] = far
        row = np.minimum(np.minimum.accumulate(best - offsets) + offsets, far)
        row[(columns < 0) | (columns > len(region))] = far
        if row.min() > most:
            return None
    end = int(row.argmin())
    return int(row[end]), int(columns[end])


def found_at(text: bytes, wanted: bytes, start: int) -> int:
    """Place at or after ``start`` where ``wanted`` stands in ``text`` (UTF-32), or -1."""
    at = text.find(wanted, 4 * start)
    while at % 4 and at >= 0:
        at = text.find(wanted, at + 1)
    return at // 4 if at >= 0 else -1


def verified(codes: np.ndarray, item: np.ndarray, low: int, high: int, most: int):
    """(start, stop, distance) of the item's best alignment on the band, or None."""
    first, last = max(0, low - most), min(len(codes), high + len(item) + most)
    region = codes[first:last]
    same = found_at(region.tobytes(), item.tobytes(), 0)
    if same >= 0:                                       # no edit: nothing to align
        return first + same, first + same + len(item), 0
    found = align(item, region, low - first, high - first, most)
    if found is None:
        return None
    distance, stop = found
    # aligned backwards from its end, the same stretch gives its start
    back = align(item[::-1], region[:stop][::-1], -most, most, distance) if distance else (0, len(item))
    back = back if back is not None else (distance, len(item))
    return first + stop - back[1], first + stop, distance


def leaks(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, stop, distance) of every leak in one text."""
    codes = folded(text)
    best: dict[int, list[tuple[int, int, int]]] = {}
    step = max(WINDOW_CHARS, 2 * index.longest)
    for begin in range(0, max(1, len(codes)), step):
        window = codes[begin:begin + step + 2 * index.longest]
        for i, low, high in candidates(window, index):
            span = verified(window, index.texts[i], low, high, int(index.edits[i]))
            if span:
                best.setdefault(i, []).append((begin + span[0], begin + span[1], span[2]))
    plain = codes.tobytes() if index.short else b""
    for i in index.short:
        wanted, at = index.texts[i].tobytes(), -1
        while (at := found_at(plain, wanted, at + 1)) >= 0:
            best.setdefault(i, []).append((at, at + len(index.texts[i]), 0))
    found = []
    for i, spans in best.items():
        kept: list[tuple[int, int, int]] = []
        for span in sorted(set(spans), key=lambda s: (s[2], s[0])):
            if all(span[1] <= k[0] or k[1] <= span[0] for k in kept):
                kept.append(span)
        found += [(i, *s) for s in kept]
    return sorted(found, key=lambda h: (h[1], h[2], h[0]))


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The items in blocks of at most ``block_chars`` characters (one item at least)."""
    block, size = Index(), 0
    items = benchmark.select("item_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    for row in items.orderBy("item_id", "text").toLocalIterator():
        codes = folded(row["text"])
        if not (codes != 32).any():
            continue
        if block.ids and size + len(codes) > block_chars:
            yield block.build()
            block, size = Index(), 0
        block.ids.append(row["item_id"])
        block.texts.append(codes)
        size += len(codes)
    if block.ids:
        yield block.build()


def leak_column(text: Column, shared) -> Column:
    """Leaks of one broadcast block as an array column."""
    @F.pandas_udf(HITS)
    def find(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([[{"item_id": index.ids[i], "start": a, "stop": b, "distance": d}
                           for i, a, b, d in leaks(t, index)] if t else [] for t in texts])

    return find(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``out``: array of (item_id, start, stop, distance), code points."""
    found = F.array().cast(HITS)
    names = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*names)
    temporary = []
    for index in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        name = free_name(docs, f"{out}_{len(temporary)}")
        docs = docs.withColumn(name, leak_column(F.col("text"), shared))
        temporary.append(name)
    found = F.concat(found, *temporary) if temporary else found
    return docs.select(*names, F.array_sort(F.transform(found, lambda h: F.struct(
        h["start"].alias("start"), h["stop"].alias("stop"), h["item_id"].alias("item_id"),
        h["distance"].alias("distance")))).alias(out))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept."""
    name = free_name(docs, "leaks")
    return find_leaks(docs, benchmark, name).where(F.size(name) == 0).select(*docs.columns)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document whether it leaks, the leaked items and their spans."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    spans = F.transform("leaks", lambda h: F.concat_ws(
        ":", *[F.coalesce(h[c].cast("string"), F.lit("")) for c in ("item_id", "start", "stop", "distance")]))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"),
        F.array_sort(F.array_distinct("leaks.item_id")).alias("items"),
        F.array_join(spans, ",").alias("spans"))
