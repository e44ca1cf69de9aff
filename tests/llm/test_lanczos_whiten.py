"""Whitening against a dense eigendecomposition in numpy."""

import numpy as np
import pytest

from ridelens.llm import lanczos_whiten as lw
from ridelens.llm.lanczos_whiten import whitening_report
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1)
                                  for i, v in zip(ids, vectors)], SCHEMA)


def check(report, vectors, components):
    """Every value of the report against the dense result, up to each component's sign."""
    found = report.toPandas()
    assert list(found.columns) == COLUMNS
    n, width = vectors.shape
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    sums = x.sum(0)
    centred = (x - 1_000_000) - (x - 1_000_000).mean(0)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    expected = centred @ axes / np.sqrt(values)
    assert len(found) == n * components and (found.n == n).all()
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.columns) == list(range(1, components + 1))
    got = wide.loc[range(n)].to_numpy()
    gaps = np.abs(np.diff(np.append(values, 0))) / values[0]
    assert np.abs(got * np.sign((got * expected).sum(0)) - expected).max() < 1e-9 / max(gaps.min(), 1e-9) * 1e-3 + 1e-9
    deviation = found.groupby("vec_id").deviation.agg(["min", "max"]).loc[range(n)]
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert deviation["min"].tolist() == exact == deviation["max"].tolist()
    shares = found.groupby("component").explained.agg(["min", "max"])
    assert (shares["min"] == shares["max"]).all()
    assert np.allclose(shares["min"], values / np.trace(covariance), rtol=1e-10)
    error = np.abs(got.T @ got / n - np.outer(got.mean(0), got.mean(0)) - np.eye(components)).max()
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9 and error < 1e-9


def test_given_table(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    dense = np.stack(vectors.orderBy("vec_id").toPandas().embedding).astype(float)
    report = whitening_report(vectors.selectExpr("vec_id", "embedding", "label"))
    check(report, dense, min(32, dense.shape[1]))


def test_far_mean_falling_spectrum(spark):
    """Deviations over three orders of magnitude on a large offset, rotated."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((10, 10)))[0]
    vectors = (rng.standard_normal((400, 10)) * np.geomspace(300, 0.3, 10)) @ turn + 5000
    check(whitening_report(frame(spark, vectors)), vectors, 10)


def test_more_entries_than_components_and_few_steps(spark):
    """Forty entries, thirty-two components; two groups of nearly equal variances."""
    rng = np.random.default_rng(2)
    scale = np.concatenate([np.linspace(50, 40, 20), np.linspace(5, 4, 20)])
    vectors = rng.standard_normal((300, 40)) * scale
    check(whitening_report(frame(spark, vectors)), vectors, 32)


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(3)
    vectors = np.zeros((60, 6))
    vectors[:, 1], vectors[:, 4] = 8 * rng.standard_normal(60), rng.standard_normal(60)
    vectors[:, 5] = 2
    check(whitening_report(frame(spark, vectors)), vectors, 2)


def test_broken_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((40, 3)) * [9, 5, 2]
    nan, inf = float("nan"), float("inf")
    broken = [None, [], [nan, 1, 2], [1, inf, 2], [1, 2, -inf], [None, 1, 2], [1, 2], [1, 2, 3, 4]]
    vectors = list(good) + broken
    check(whitening_report(frame(spark, vectors, range(len(vectors)))), good, 3)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 2)) * [4, 1]
    vectors, ids = np.concatenate([base, base]), [None, *range(1, 20)] * 2
    table = frame(spark, vectors, ids)
    for name in ("x", "c", "part", "i", "n", "whitened", "component"):
        table = table.selectExpr("*", f"'clash' AS {name}")
    found = whitening_report(table).toPandas()
    assert len(found) == 80 and found.vec_id.isna().sum() == 4
    assert (found.groupby(["vec_id", "component"]).size() == 2).all()


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    found = whitening_report(frame(spark, vectors))
    assert found.columns == COLUMNS and found.collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    found = whitening_report(frame(spark, [[1e13, 0.0], [-1e13, 1.0], [0.0, 2.0]])).toPandas()
    assert found[found.vec_id == 0].deviation.isna().all()


def test_bidiagonal_form_and_orthogonality(spark):
    """The directions are orthonormal, and a pass gives the products it should."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((200, 12)) * np.geomspace(60, 1, 12)
    rows = lw.Rows(frame(spark, vectors))
    x = np.floor(64 * vectors)
    a = (x - x.mean(0)) / np.sqrt(200)
    values, directions = lw.bidiagonalise(rows, 12)
    assert np.abs(directions.T @ directions - np.eye(12)).max() < 1e-13
    assert np.allclose(values, np.linalg.svd(a)[1], rtol=1e-12)
    ys, v = rng.standard_normal((12, 3)), rng.standard_normal(12)
    c, square, back = rows.products(ys, v)
    assert np.allclose(c, (a @ ys).T @ (a @ v)) and np.allclose(square, (a @ v) @ (a @ v)) and np.allclose(back, a.T @ (a @ v))
