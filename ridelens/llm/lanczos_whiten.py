"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers (``x = floor(64 c) + 1000000``); the rows, centred, are a
tall matrix A. Each step multiplies a direction v by A and the result u by the
transpose, both distributed over the rows, and reorthogonalises u against all
earlier ones and v against all earlier directions. What is left is a bidiagonal
matrix as small as the vectors are long; its singular values and vectors give
the components and deviations of the rows.

One pass over the rows serves a step. The long vectors u are never stored: each
is A y for a short y, so a pass makes them again for its rows, and adds up
``U'Av``, ``|Av|^2`` and ``A'Av`` at once. Where removing the earlier u leaves
little of Av (a tenth of its length), the pass is repeated on what was left, as
its length would otherwise lose digits.

The rows are centred before any product: the integer part of each mean is
subtracted as an integer, then the fraction, so the large offset costs no digit.
Work per pass is one row per task, added up by place; nothing grows on the
driver with the rows, and a lost task is computed again from the checkpoint.

Defined results: a vector that is NULL or empty, or holds a NULL or a
non-finite entry, has no rows; vectors of another length than the most
frequent one (of two, the longer) are left out as well; a NULL vec_id is kept;
repeated rows each have theirs; entries beyond +-2^46 count as that; a
deviation beyond a long is NULL. Directions without variance (below 1e-13 of
the greatest) are no components, so identical vectors, or a single one, give
no rows, and no vectors give none. Other columns are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage
from ridelens.llm.vectors import finite, from_binary, from_lists, to_binary, to_lists

SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0 ** 46
COMPONENTS = 32
ROWS_A_TASK = 8192
NO_VARIANCE = 1e-13
LOST = 0.01            # share of |Av|^2 below which what is left is measured again


def _integers(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, x as binary) of the usable vectors, checkpointed, their count and length."""
    usable = vectors.select("vec_id", F.col("embedding").alias("c")).where(finite(F.col("c")))
    common = usable.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width, n = (common["width"], common["count"]) if common else (0, 0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.clip(from_lists(batch.column("c"), np.float64), -LARGEST, LARGEST)
            x = np.floor(SCALE * c).astype(np.int64) + SHIFT
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), to_binary(x)], ["vec_id", "x"])

    rows = usable.where(F.size("c") == width).select(F.col("vec_id").cast("long").alias("vec_id"), "c")
    rows = rows.coalesce(max(1, math.ceil(n / ROWS_A_TASK))).mapInArrow(packed, "vec_id long, x binary")
    return cut_lineage(rows), n, width


def _totals(rows: DataFrame, partial, kind: str) -> list:
    """Sum over all tasks of the list that ``partial`` makes of a task's matrices of x."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(from_binary(batch.column("x"), np.int64) for batch in batches if batch.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([to_lists(found.reshape(1, -1))], ["part"])

    parts = rows.select("x").mapInArrow(task, f"part array<{kind}>").select(F.posexplode("part").alias("i", "v"))
    return [r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]


def _added(found, more):
    return more if found is None else found + more


class Rows:
    """The centred matrix over the square root of its height, by products that Spark adds up."""

    def __init__(self, vectors: DataFrame):
        self.table, self.n, self.width = _integers(vectors)
        if self.n:
            def sums(matrices):
                found = None
                for x in matrices:
                    found = _added(found, x.sum(0))
                return found

            sums = _totals(self.table, sums, "long")
            self.whole = np.array([s // self.n for s in sums], np.int64)
            self.rest = [s % self.n for s in sums]      # S = n * whole + rest
            self.part = np.array([r / self.n for r in self.rest])

    def centred(self):
        """Function of a matrix of x: the centred rows in double precision."""
        whole, part = self.whole, self.part
        return lambda x: (x - whole) - part

    def products(self, ys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'w, |w|^2 and A'w for w = A v, where U = A ys: one pass over the rows."""
        centred, k = self.centred(), ys.shape[1]
        directions = np.column_stack([ys, v])

        def partial(matrices):
            found = None
            for x in matrices:
                a = centred(x)
                u = a @ directions
                w = u[:, k]
                found = _added(found, np.concatenate([u.T @ w, a.T @ w]))
            return found

        total = np.array(_totals(self.table, partial, "double")) / self.n
        return total[:k], total[k], total[k + 1:]


def _away(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``r`` orthogonal to the basis, twice over."""
    for _ in range(2):
        r = r - basis @ (basis.T @ r)
    return r


def bidiagonalise(rows: Rows, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors of the rows: at least ``wanted``
    of them exact to rounding, or all."""
    width = rows.width
    random = np.random.default_rng(seed)
    vs = np.zeros((width, 0))
    ys, zs, gram = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((0, 0))
    alphas, betas, coupling = [], [], 0.0
    v = random.standard_normal(width)
    v /= np.linalg.norm(v)
    while True:
        k = len(alphas)
        vs = np.column_stack([vs, v])
        y, z, square, scale = v, None, 0.0, None
        for _ in range(3):
            c, square, z = rows.products(ys, y)
            scale = square if scale is None else scale
            drop = c + (c - gram @ c)
            y, z = y - ys @ drop, z - zs @ drop
            left = square - 2 * drop @ c + drop @ gram @ drop
            mates = c - gram @ drop
            if left > LOST * square or left <= NO_VARIANCE * max(scale, *(a * a for a in alphas), 1e-300):
                break
        alpha = math.sqrt(left) if left > NO_VARIANCE * max(scale, *(a * a for a in alphas), 1e-300) else 0.0
        if alpha:
            y, z, mates = y / alpha, z / alpha, mates / alpha
        else:
            y, z, mates = np.zeros(width), np.zeros(width), np.zeros(k)
        ys, zs = np.column_stack([ys, y]), np.column_stack([zs, z])
        gram = np.block([[gram, mates[:, None]], [mates[None, :], np.array([[1.0 if alpha else 0.0]])]])
        alphas.append(alpha)
        betas.append(coupling)
        small = np.diag(alphas) + np.diag(betas[1:], 1)
        if k + 1 == width:
            break
        r = _away(z - alpha * v, vs)
        coupling = float(np.linalg.norm(r))
        greatest = max(max(alphas), max(betas))
        if coupling <= 1e-14 * greatest:
            # the directions so far are closed under the rows: go on with a fresh one
            coupling, r = 0.0, _away(random.standard_normal(width), vs)
        if k + 1 >= wanted and coupling:
            left_vectors, values, _ = np.linalg.svd(small)
            if (coupling * np.abs(left_vectors[-1, :wanted]) <= 1e-15 * values[0]).all():
                break
        v = r / np.linalg.norm(r)
    _, values, right = np.linalg.svd(small)
    return values, vs @ right.T


class Whitening:
    """Components, eigenvalues and the measured quality of the whitening of a table."""

    def __init__(self, vectors: DataFrame, wanted: int = COMPONENTS):
        self.rows = Rows(vectors)
        self.values, self.components = np.zeros(0), np.zeros((self.rows.width, 0))
        if self.rows.n:
            deviations, directions = bidiagonalise(self.rows, min(wanted, self.rows.width))
            keep = min(wanted, int((deviations ** 2 > NO_VARIANCE * max(deviations[0] ** 2, 1e-300)).sum()))
            self.values = deviations[:keep] ** 2
            found = directions[:, :keep]
            heaviest = np.abs(found).argmax(0)
            self.components = found * np.sign(found[heaviest, np.arange(keep)])
        if len(self.values):
            self._measure()

    def _measure(self):
        """Trace of the covariance, and how far the whitened rows' covariance is from one."""
        centred, k, n = self.rows.centred(), len(self.values), self.rows.n
        turned = self.components / np.sqrt(self.values)

        def partial(matrices):
            found = None
            for x in matrices:
                a = centred(x)
                w = a @ turned
                found = _added(found, np.concatenate([(w.T @ w).ravel(), w.sum(0), [np.einsum("ij,ij->", a, a)]]))
            return found

        total = np.array(_totals(self.rows.table, partial, "double")) / n
        mean = total[k * k:k * k + k]
        covariance = total[:k * k].reshape(k, k) - np.outer(mean, mean)
        self.identity_error = float(np.abs(covariance - np.eye(k)).max())
        self.trace = float(total[-1])

    def whitened(self) -> DataFrame:
        """(vec_id, deviation, whitened) of every usable row, all components in one array."""
        rows = self.rows
        if not len(self.values):
            return rows.table.sparkSession.createDataFrame([], "vec_id long, deviation long, whitened array<double>")
        centred, whole, rest, n = rows.centred(), rows.whole, rows.rest, rows.n
        turned = self.components / np.sqrt(self.values)

        def deviation(x: np.ndarray) -> pa.Array:
            d = x - whole
            most = n * (int(np.abs(d).max()) + 1)
            if d.shape[1] * most * most < 2 ** 63:
                return pa.array(((n * d - np.array(rest, np.int64)) ** 2).sum(1))
            exact = ((n * d.astype(object) - np.array(rest, object)) ** 2).sum(1)
            return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = from_binary(batch.column("x"), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), deviation(x), to_lists(centred(x) @ turned)],
                        ["vec_id", "deviation", "whitened"])

        return rows.table.mapInArrow(task, "vec_id long, deviation long, whitened array<double>")


def whitening_report(vectors: DataFrame) -> DataFrame:
    """One row per usable vector and component: the whitened value, its component's share of
    the variance, the vector's exact deviation, and the whitening's error."""
    found = Whitening(vectors)
    if not len(found.values):
        shares, error = F.array().cast("array<double>"), F.lit(None).cast("double")
    else:
        shares = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
        error = F.lit(found.identity_error)
    opened = found.whitened().select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return opened.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(found.rows.n).cast("long").alias("n"),
                         "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"),
                         error.alias("identity_error"))
