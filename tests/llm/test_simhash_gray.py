import random
import re
from itertools import combinations

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from ridelens.llm import simhash_gray as op
from ridelens.llm.components import components

SCHEMA = "doc_id BIGINT, text STRING, fp STRING, first_id STRING, component_id INT"


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, max_bits):
    """Least reachable id per position, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= max_bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def cloud(rng, n, centre, flips):
    return list({centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(flips))})
                 for _ in range(n)})


@pytest.mark.parametrize("part_rows", [60_000, 20])
@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_links_give_the_components_of_all_pairs(spark, max_bits, part_rows):
    rng = random.Random(max_bits)
    prints = sorted({p for c in range(4) for p in cloud(rng, 60, rng.getrandbits(64), 6)}
                    | {rng.getrandbits(64) for _ in range(60)} | {0, 1, 2**63, 2**64 - 1})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp BIGINT")
    links = op.links(df, max_bits, target_rows=40, part_rows=part_rows)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(p, p) for p in signed]
    want = brute_classes(prints, max_bits)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_links_are_no_more_than_the_members(spark):
    rng = random.Random(1)
    prints = cloud(rng, 400, rng.getrandbits(64), 4)
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp BIGINT")
    assert op.links(df, 2).count() <= 3 * len(prints)


def test_gray_rank_orders_neighbours_by_one_bit():
    ranks = op.gray_rank(np.arange(256, dtype=np.uint64))
    order = np.argsort(ranks)
    assert sorted(ranks) == list(range(256))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


def text_rows(rng):
    vocabulary = ["alpha", "Beta", "gamma", "ÉTÉ", "delta", "x", " y", "zeta."]
    base = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "one two", "One TWO", "A\x0bb\x0cc\rd", *base]
    for t in base:
        words = t.split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("  ".join(words))
    return texts + base[:2]


def test_documents_against_brute_force(spark):
    texts = text_rows(random.Random(2))
    rows = [(100 - i, t, "f", "o", 7) for i, t in enumerate(texts)] + [(100, None, "f", "o", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = [brute_print(t) for _, t, *_ in rows]
    roots = brute_classes(prints, 2)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in roots}
    want = sorted((row[0], f"{p:016x}", least[r]) for row, p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, op.near_duplicates(docs, target_rows=3).collect())) == want

    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_null_and_repeated_ids(spark):
    rows = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (5, "completely other words here"),
            (5, "yet another unlike text now"), (9, "yet another unlike text now"),
            (None, "yet another unlike text now")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(map(tuple, op.keep_first(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3]], key=str)
    assert {r.component_id for r in op.near_duplicates(docs).collect()} == {None, 5}


def test_long_text_is_read_in_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcXYZé", k=rng.randrange(1, 9))) for _ in range(900))
    whole = op.fingerprint(text.encode())
    assert whole == brute_print(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(op, "BLOCK_BYTES", size)
        assert op.fingerprint(text.encode()) == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.near_duplicates(docs).collect() == [] and op.keep_first(docs).collect() == []
