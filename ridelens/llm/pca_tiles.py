"""Embedding near-duplicates by tiled comparison in PCA order.

Vectors of one label are compared with each other: no index that could miss a
pair, but most of the arithmetic is left out. All vectors are turned into the
principal axes of a sample, so that the leading coordinates carry most of every
difference. Inside a label they are sorted along a curve through the first three
axes and cut into panels of at most ``PANEL_ROWS``; a panel pair whose boxes of
leading coordinates are further apart than the threshold allows is never formed.
A pair of panels is compared tile by tile: the products of the leading axes are
summed first, the rest is bounded by the product of the suffix norms, and a tile
or pair stops as soon as the bound is below the threshold. Cosines within 1e-9 of
the threshold are computed again from the vectors as given.

Equal vectors of a label are compared once and counted as often as they occur, so
that a vector which a third of all rows hold is one row of a panel; such rows find
their result by a broadcast of the vectors that hold more than a thousandth of
all rows (at most a thousand). A panel pair returns how many links each vector has
and a spanning forest of its links, never all of them, so a dense cloud of near
copies returns no more than its size. Panels get exact places from a range sort,
so a label with most rows is many panels; a task holds two of them.

Defined results: a vector that is NULL, empty, zero or holds a NULL or non-finite
entry, or whose label is NULL, links with nothing (component: its own id); vectors
of different lengths do not link; repeated rows are rows of their own, linked with
each other; a NULL vec_id counts for nothing in a component's least id, which is
NULL where no member has an id, and is kept if that is so; no vectors, no rows.
Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage
from ridelens.llm.components import components
from ridelens.llm.placing import placed
from ridelens.llm.vectors import finite, from_binary, from_lists, to_binary, to_lists

THRESHOLD = 0.98
PANEL_ROWS = 4096
TILE_ROWS = 256
LEADING = 8            # axes summed first; also those of the boxes
CURVE_AXES, CURVE_BITS = 3, 6
SAMPLE_ROWS = 4096     # vectors that the axes are fitted on, about
HEAVY_SHARE = 1000     # a vector on more than one row in so many is broadcast
CLOSE = 1e-9


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so that no square over- or underflows)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted_axes(vectors: DataFrame, n: int, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Principal axes, most variance first, of a hash sample of about ``rows`` of the ``n``
    distinct vectors, for the length that most of these have; other lengths are not turned."""
    some = vectors.where(F.pmod(F.xxhash64("uid"), F.lit(max(1, n // rows))) == 0)
    found: dict[int, list] = {}
    for row in some.select("vector").toLocalIterator():
        found.setdefault(len(row.vector), []).append(row.vector)
    if not found:
        return {}
    width, sample = max(found.items(), key=lambda item: (len(item[1]), item[0]))
    x = _units(np.array(sample, np.float64))
    centred = x - x.mean(0)
    return {width: np.linalg.eigh(centred.T @ centred)[1][:, ::-1]}


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    units = _units(x)
    return units @ axes[x.shape[1]] if x.shape[1] in axes else units


def curve_rank(leading: np.ndarray) -> np.ndarray:
    """Place of a point on a Z-shaped curve through the first axes."""
    cells = np.clip((leading[:, :CURVE_AXES] + 1) * 2 ** (CURVE_BITS - 1), 0, 2 ** CURVE_BITS - 1).astype(np.int64)
    rank = np.zeros(len(cells), np.int64)
    for bit in reversed(range(CURVE_BITS)):
        for axis in range(cells.shape[1]):
            rank = rank << 1 | cells[:, axis] >> bit & 1
    return rank


def _laid_out(vectors: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(tree, uid, id, copies, x, leading, rank): each vector as bytes with its leading coordinates."""
    kind = np.float32 if vectors.schema["vector"].dataType.elementType.typeName() == "float" else np.float64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for width in np.unique(sizes):
                some = batch.filter(pa.array(sizes == width))
                x = from_lists(some.column("vector"), kind)
                leading = _turned(x.astype(np.float64), axes)[:, :LEADING]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("tree", "uid", "id", "copies")]
                    + [to_binary(x), to_lists(leading), pa.array(curve_rank(leading))],
                    ["tree", "uid", "id", "copies", "x", "leading", "rank"])

    tree = vectors.schema["tree"].dataType.simpleString()
    return vectors.mapInArrow(task, f"tree {tree}, uid long, id long, copies long, x binary, "
                                    "leading array<double>, rank long")


def _panel_pairs(rows: DataFrame, reach: float) -> DataFrame:
    """(tree, a, b) of the panels, a <= b, whose boxes are within ``reach`` of each other."""
    sides = [F.get("leading", F.lit(i)) for i in range(LEADING)]
    panels = rows.groupBy("tree", "panel").agg(
        F.array(*[F.min(s) for s in sides]).alias("low"), F.array(*[F.max(s) for s in sides]).alias("high"),
        F.max("size").alias("size"))
    last = F.floor((F.col("size") - 1) / PANEL_ROWS)
    left = panels.select("tree", F.col("panel").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                         F.explode(F.sequence("panel", last)).alias("b"))
    right = panels.select("tree", F.col("panel").alias("b"), "low", "high")
    apart = [F.greatest(F.get("low", F.lit(i)) - F.get("high_a", F.lit(i)),
                        F.get("low_a", F.lit(i)) - F.get("high", F.lit(i)), F.lit(0.0)) for i in range(LEADING)]
    square = sum((F.coalesce(g * g, F.lit(0.0)) for g in apart[1:]), F.coalesce(apart[0] * apart[0], F.lit(0.0)))
    return left.join(right, ["tree", "b"]).where(square <= reach * reach).select("tree", "a", "b")


class _Forest:
    """Joins of numbered members, and the links that made them."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _flat(self):
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]

    def join(self, i: np.ndarray, j: np.ndarray):
        """Links between members: those that join two trees are kept."""
        self._flat()
        while True:
            p, q = self.root[i], self.root[j]
            new = np.flatnonzero(p != q)
            if not len(new):
                return
            i, j = i[new], j[new]
            # one link per tree at a time; the rest is looked at again with the trees joined
            _, first = np.unique(np.minimum(p[new], q[new]), return_index=True)
            for a, b in zip(i[first], j[first]):
                a_root, b_root = self._find(a), self._find(b)
                if a_root != b_root:
                    self.root[max(a_root, b_root)] = min(a_root, b_root)
                    self.links.append((a, b))
            self._flat()


class _Side:
    """One panel: vectors as given, turned to the axes, and norms of what follows each stop."""

    def __init__(self, table: pa.Table, axes: dict[int, np.ndarray], kind):
        table = table.combine_chunks()
        self.table = table
        self.x = from_binary(table.column("x").combine_chunks(), kind).astype(np.float64)
        self.turned = _turned(self.x, axes)
        width = self.x.shape[1]
        self.stops = [0]
        while self.stops[-1] < width:
            self.stops.append(min(width, max(LEADING, 2 * self.stops[-1])))
        squares = self.turned ** 2
        self.rest = np.column_stack([np.sqrt(squares[:, s:].sum(1)) for s in self.stops])
        self.copies = table.column("copies").to_numpy()
        self.links = np.zeros(len(self.x), np.int64)
        self.boxes = [(t, t[:, :LEADING].min(0), t[:, :LEADING].max(0)) for t in
                      (self.turned[s:s + TILE_ROWS] for s in range(0, len(self.x), TILE_ROWS))]


def _tile_links(a: _Side, b: _Side, i0: int, j0: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile of ``a`` and a tile of ``b`` that reach the threshold."""
    x, y = a.turned[i0:i0 + TILE_ROWS], b.turned[j0:j0 + TILE_ROWS]
    u, v = a.rest[i0:i0 + TILE_ROWS], b.rest[j0:j0 + TILE_ROWS]
    least = threshold - CLOSE
    products, pairs = np.zeros((len(x), len(y))), None
    for k in range(1, len(a.stops)):
        part = slice(a.stops[k - 1], a.stops[k])
        if pairs is None:
            products += x[:, part] @ y[:, part].T
            open_ = products + np.outer(u[:, k], v[:, k]) >= least
            count = int(open_.sum())
            if count == 0:
                return np.zeros(0, int), np.zeros(0, int)
            if count * 8 < open_.size or k == len(a.stops) - 1:
                pairs = np.nonzero(open_)
                sums = products[pairs]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ij->i", x[i, part], y[j, part])
            kept = sums + u[i, k] * v[j, k] >= least
            pairs, sums = (i[kept], j[kept]), sums[kept]
            if not len(sums):
                break
    i, j = pairs[0] + i0, pairs[1] + j0
    near = np.abs(sums - threshold) <= CLOSE
    if near.any():
        p, q = a.x[i[near]], b.x[j[near]]
        exact = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
        kept = np.ones(len(i), bool)
        kept[near] = exact >= threshold
        i, j = i[kept], j[kept]
    return i, j


def compared(a: _Side, b: _Side, same: bool, threshold: float) -> list[tuple[int, int]]:
    """Counts the links between two panels (or inside one) and returns a forest of them;
    members of ``b`` are numbered after those of ``a``."""
    shift = 0 if same else len(a.x)
    forest = _Forest(len(a.x) + (0 if same else len(b.x)))
    reach = 2 - 2 * threshold + CLOSE
    for i, (_, low_a, high_a) in enumerate(a.boxes):
        for j, (_, low_b, high_b) in enumerate(b.boxes):
            if same and j < i:
                continue
            gaps = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
            if gaps @ gaps > reach:
                continue
            p, q = _tile_links(a, b, i * TILE_ROWS, j * TILE_ROWS, threshold)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                a.links += np.bincount(p, b.copies[q], len(a.x)).astype(np.int64)
                b.links += np.bincount(q, a.copies[p], len(b.x)).astype(np.int64)
                forest.join(p, q + shift)
    return forest.links


_FOUND = "uid long, id long, links long, mate_uid long, mate_id long"


def _compare(rows: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], kind, threshold: float) -> DataFrame:
    """Link counts per vector and panel pair, and the links of a spanning forest."""
    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # tiles follow the curve, whatever order the rows came in
        own = table.column("panel").to_numpy() == key[1].as_py()
        order = lambda t: t.take(pa.array(np.argsort(t.column("place").to_numpy())))
        a = _Side(order(table.filter(pa.array(own))), axes, kind)
        b = a if own.all() else _Side(order(table.filter(pa.array(~own))), axes, kind)
        forest = compared(a, b, a is b, threshold)
        members = a.table if a is b else pa.concat_tables([a.table, b.table])
        uid, ident = members.column("uid").combine_chunks(), members.column("id").combine_chunks()
        links = pa.array(a.links if a is b else np.concatenate([a.links, b.links]))
        linked = pa.array(np.flatnonzero(links.to_numpy()))
        left = pa.array([i for i, _ in forest], pa.int64())
        right = pa.array([j for _, j in forest], pa.int64())
        counts = [uid.take(linked), ident.take(linked), links.take(linked),
                  pa.nulls(len(linked), pa.int64()), pa.nulls(len(linked), pa.int64())]
        edges = [uid.take(left), ident.take(left), pa.nulls(len(left), pa.int64()), uid.take(right), ident.take(right)]
        return pa.table([pa.chunked_array([c, e]) for c, e in zip(counts, edges)],
                        names=["uid", "id", "links", "mate_uid", "mate_id"])

    sides = pairs.select("tree", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("panel"))
    dealt = rows.select("tree", "panel", "place", "uid", "id", "copies", "x").join(sides, ["tree", "panel"])
    # the panel pair in the second key place tells which side a row is on
    return dealt.groupBy("tree", "a", "b").applyInArrow(pair, _FOUND)


def _node(ident: Column, uid: Column) -> Column:
    """A vector as a node whose order is that of its least id, those without one last."""
    return F.struct(ident.isNull().alias("none"), ident.alias("id"), uid.alias("uid"))


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, vector, copies, n_links, component_id) of the distinct vectors ``(label, vector,
    id, copies, uid)``, which must be the same whenever they are computed."""
    axes = fitted_axes(vectors, vectors.count())
    kind = np.float32 if vectors.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    trees = vectors.withColumn("tree", F.struct("label", F.size("vector").alias("width")))
    rows = placed(_laid_out(trees.select("tree", "uid", "id", "copies", "vector"), axes), "rank", "uid")
    rows = rows.withColumn("panel", F.floor(F.col("place") / PANEL_ROWS))
    pairs = _panel_pairs(rows, float(np.sqrt(2 - 2 * threshold + CLOSE)))
    found = cut_lineage(_compare(rows, pairs, axes, kind, threshold))
    links = found.where("links IS NOT NULL").groupBy("uid").agg(F.sum("links").alias("links"))
    forest = found.where("mate_uid IS NOT NULL").select(
        _node(F.col("id"), F.col("uid")).alias("a"), _node(F.col("mate_id"), F.col("mate_uid")).alias("b"))
    roots = components(forest).select(F.col("node.uid").alias("uid"), F.col("root").alias("root"))
    whole = vectors.join(links, "uid", "left").join(roots, "uid", "left")
    return whole.select(
        "label", "vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root.id")).alias("component_id"))


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label")
    usable = F.col("label").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda e: e != 0)
    usable = F.coalesce(usable, F.lit(False))
    distinct = rows.where(usable).groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id"))
    distinct = cut_lineage(distinct.withColumn("uid", F.monotonically_increasing_id()))
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    found = cut_lineage(linked_vectors(distinct, threshold))
    heavy = found.where(F.col("copies") * HEAVY_SHARE > total).drop("copies")
    light = found.where(F.col("copies") * HEAVY_SHARE <= total).drop("copies")
    key = ["label", "vector"]
    few = F.broadcast(heavy)
    parts = [rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id")),
             rows.where(usable).join(few, key).select("vec_id", "n_links", "component_id"),
             rows.where(usable).join(few, key, "left_anti").join(light, key).select("vec_id", "n_links", "component_id")]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
