"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from ridelens.llm import merkle_manifest as merkle
from ridelens.llm.merkle_manifest import ARITY, BLOCK, manifest_report

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                       for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def way(levels, i):
    found = []
    for below in levels[:-1]:
        start = i - i % ARITY
        found.append(("".join(below[start:i]), "".join(below[i + 1:start + ARITY])))
        i //= ARITY
    return found


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        h = leaf(doc_id, source, lang, n_chars, text)
        found = h
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            found = leaf(doc_id, source, lang, n_chars, lowered)
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, h, found, doc_id))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {k: tree([m[2] for m in sorted(by[k], key=lambda m: m[:3])]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, (*_, h, found, doc_id) in enumerate(sorted(by[k], key=lambda m: m[:3])):
            path, back = way(trees[k], i) + way(top, j), found
            for left, right in path:
                back = sha(left + back + right)
            out.append((doc_id, h, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)),
                        back, back == top[-1][0]))
    return out


def canon(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def check(spark, rows):
    found = manifest_report(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == COLUMNS
    assert canon(found.collect()) == canon(brute(rows))


def test_every_depth_and_partial_runs(spark):
    """Languages of 1, 8, 9, 64, 65, 512, 513 and 600 leaves: stored levels are reached and passed."""
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "é": 65, None: BLOCK, "g": BLOCK + 1, "": 600}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 10007, f"Text {n}\nÄÖ", lang, f"s{n % 3}", n))
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "en", None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "A", "en", "s", 1),
            (None, "A", "en", "s", 1), (None, None, None, None, None), (5, "x" * 300_000, "de", "s", 1),
            (6, "ABC", "de", "s", -3), (9, "ABC", "de", "s", 3)] + [(77, "Same", "fr", "s", 4)] * 20
    check(spark, rows)


def test_one_row_is_its_own_root(spark):
    rows = [(12, "Alone", "en", "s", 5)]
    check(spark, rows)
    found = manifest_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert found.leaf == found.subroot == found.root and found.proof_sha256 == sha("")


def test_many_languages_make_a_deep_top_tree(spark):
    check(spark, [(i, f"T{i}", f"l{i % 75:03d}", "s", i) for i in range(150)])


def test_empty_table_and_clashing_columns(spark):
    assert manifest_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, f"T{i}", "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "digest", "place", "size", "path", "root", "found", "depth", "part"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    assert canon(manifest_report(docs).collect()) == canon(brute(rows))


@pytest.mark.parametrize("size, depth", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (8**6, 6), (8**6 + 1, 7)])
def test_depth(spark, size, depth):
    found = spark.range(1).selectExpr(f"{size}L AS n").select(merkle._depth(merkle.F.col("n")).alias("d")).first().d
    assert found == depth


def test_only_every_third_level_is_stored(spark):
    rows = spark.range(BLOCK * 2).selectExpr("'t' AS tree", "id AS doc_id", "sha2(cast(id AS string), 256) AS digest")
    trees, ways, root = merkle.dataset_manifest(rows, ["doc_id"])
    assert [level.count() for level in trees.levels] == [2, 1]
    assert trees.levels[1].first().nodes[1].place == 1
    assert ways.first().top == root
