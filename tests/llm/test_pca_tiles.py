"""Embedding near-duplicates against all pairs in numpy."""

import numpy as np
import pytest

from ridelens.llm import pca_tiles as tiles
from ridelens.llm.pca_tiles import near_embeddings

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=tiles.THRESHOLD):
    """rows: (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows[:i]):
            ok = a is not None and a == b and all(
                v and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in (x, y)) and len(x) == len(y)
            if ok and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i, j] = links[j, i] = True
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(links)):
            if root[j] < root[i]:
                root[i], changed = root[j], True
    least = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return [(rows[i][0], int(links[i].sum()), least[root[i]], rows[i][0] == least[root[i]]) for i in range(n)]


def check(spark, rows, schema=SCHEMA):
    found = near_embeddings(spark.createDataFrame(rows, schema))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def clouds(rng, centres, each, width, spread):
    points = rng.standard_normal((centres, width))
    return np.concatenate([p + spread * rng.standard_normal((each, width)) for p in points])


@pytest.fixture
def small_panels(monkeypatch):
    monkeypatch.setattr(tiles, "PANEL_ROWS", 40)
    monkeypatch.setattr(tiles, "TILE_ROWS", 8)


def test_clouds_over_many_panels_and_labels(spark, small_panels):
    """Loose clouds whose pairs fall on both sides of the threshold, chains included."""
    rng = np.random.default_rng(1)
    x = clouds(rng, 12, 25, 24, 0.16)
    check(spark, [(i * 13 % 307, v.tolist(), int(i % 3)) for i, v in enumerate(x)])


def test_dense_cloud_is_one_component(spark, small_panels):
    rng = np.random.default_rng(2)
    x = clouds(rng, 1, 150, 16, 0.02)
    check(spark, [(1000 - i, v.tolist(), 7) for i, v in enumerate(x)])


def test_chain_reaches_its_least_id(spark, small_panels):
    """Neighbours on a circle link, the ends do not; the least id is in the middle."""
    step = np.arccos(0.985)
    rows = [(abs(i - 30) * 2 + (i > 30), [float(np.cos(i * step)), float(np.sin(i * step))], 1) for i in range(34)]
    check(spark, rows)


def test_threshold_itself_links(spark):
    """Cosine exactly at, just above and just below the threshold, in short and scaled vectors."""
    t = tiles.THRESHOLD
    rest = (1 - t * t) ** 0.5
    rows = [(1, [1.0, 0.0], 1), (2, [t + 1e-12, rest], 1), (3, [t - 1e-7, rest], 2), (4, [1e-160, 0.0], 2),
            (5, [1.0, 0.0], 2), (6, [5e7, 0.0], 2)]
    check(spark, [r for r in rows if r[0] != 4])
    found = {r.vec_id: r.n_links for r in near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[4] == 2        # tiny vectors are scaled before they are squared


def test_broken_vectors_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    ok = [0.5, 0.25, 1.0]
    rows = [(1, ok, 1), (2, ok, 1), (2, ok, 1), (None, ok, 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1),
            (6, [nan, 1.0, 2.0], 1), (7, [inf, 1.0, 2.0], 1), (8, [None, 1.0, 2.0], 1), (9, ok, None), (10, ok, None),
            (11, [0.5, 0.25], 1), (12, [0.5, 0.26], 1), (13, [-0.0, 1.0], 5), (14, [0.0, 1.0], 5),
            (None, [9.0, -9.0, 1.0], 3), (None, [9.0, -9.0, 1.0], 3)]
    check(spark, rows)


def test_a_third_of_the_rows_hold_one_vector(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(12)
    x = [hot] * 120 + list(hot + 0.05 * rng.standard_normal((20, 12))) + list(rng.standard_normal((160, 12)))
    check(spark, [(900 - i, v.tolist(), i % 2) for i, v in enumerate(x)])


def test_no_rows_and_clashing_columns(spark):
    assert near_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "uid", "id", "copies", "x", "vector", "n_links", "place", "a", "b", "panel"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    assert sorted(map(tuple, near_embeddings(frame).collect())) == sorted(brute(rows))


def test_float_vectors(spark):
    rng = np.random.default_rng(5)
    x = clouds(rng, 5, 10, 20, 0.12).astype(np.float32)
    check(spark, [(i, v.astype(float).tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_comparison_leaves_out_arithmetic():
    """In PCA order most pairs of a spread-out set stop after the leading axes."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64)) * np.geomspace(1, 0.05, 64)
    units = tiles._units(x)
    centred = units - units.mean(0)
    turned = units @ np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    rest = np.sqrt((turned[:, tiles.LEADING:] ** 2).sum(1))
    bound = turned[:, :tiles.LEADING] @ turned[:, :tiles.LEADING].T + np.outer(rest, rest)
    assert (bound >= tiles.THRESHOLD).mean() < 0.1
    assert ((units @ units.T >= tiles.THRESHOLD) <= (bound >= tiles.THRESHOLD - tiles.CLOSE)).all()


def test_forest_joins_all_links():
    rng = np.random.default_rng(7)
    i, j = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    forest = tiles._Forest(300)
    forest.join(i[:200], j[:200])
    forest.join(i[200:], j[200:])
    again = tiles._Forest(300)
    for a, b in forest.links:
        again.join(np.array([a]), np.array([b]))
    forest._flat(), again._flat()
    assert (forest.root == again.root).all() and (forest.root[i] == forest.root[j]).all()
    assert len(forest.links) == 300 - len(set(forest.root))
