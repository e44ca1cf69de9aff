import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ridelens.llm import line_chunks as op

SCHEMA = "doc_id BIGINT, text STRING, row STRING, place INT, body STRING, removed_lines STRING"


def brute_chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        rolled = sum(op.BASE ** k * h[i - k] for k in range(op.WINDOW) if i >= k)
        if rolled % op.DIVISOR == 0 or i == len(lines) - 1:
            chunks.append(lines[start:i + 1])
            start = i + 1
    return chunks


def brute(rows):
    """Cleaned text and removed (chunks, lines) per (id, text), ids unique or texts equal."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, gone = [], []
        for k, chunk in enumerate(brute_chunks(text)):
            repeat = len(chunk) >= op.MIN_LINES and seen.setdefault(tuple(chunk), (doc, text, k)) != (doc, text, k)
            (gone if repeat else kept).append("\n".join(chunk))
        cleaned = "\n".join(kept) if gone else text
        out[doc, text] = (cleaned, len(gone), sum(g.count("\n") + 1 for g in gone))
    return out


def make_rows(rng):
    vocabulary = ["", " ", "header", "footer é", "a b c", *(f"line {i}" for i in range(12))]
    block = [rng.choice(vocabulary) for _ in range(20)]
    rows = [(0, None), (1, ""), (2, "one line"), (3, "one line"), (4, "\n\n\n\n\n\n")]
    for i in range(5, 60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        at = rng.randrange(15)
        rows.append((i, "\n".join(own[:3] + block[at:at + rng.randrange(12)] + own[3:])))
    rows += [(100 + i, rows[20][1]) for i in range(20)]          # a hot group of copies
    return rows + [rows[30], (None, rows[21][1])]                 # a repeated row, a NULL id


def narrow(body):
    return F.length(body).cast("long") % 3


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, narrow])
def test_against_brute_force(spark, chunk_hash):
    rows = make_rows(random.Random(3))
    docs = spark.createDataFrame([(*r, "r", 1, "b", "x") for r in rows], SCHEMA)
    out = op.remove_repeats(docs, chunk_hash)
    assert out.columns == ["doc_id", "text", "row", "place", "body", "removed_chunks", "removed_lines"]
    want = brute(rows)
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.removed_chunks, r.removed_lines) for r in got) == \
        sorted((d is None, d, *want[d, t]) for d, t in rows)
    assert sum(r.removed_chunks for r in got) > 30


def test_boundaries_resist_a_shift(spark):
    rng = random.Random(4)
    lines = [f"{rng.random()}" for _ in range(200)]
    texts = ["\n".join(lines), "\n".join(lines[:50] + ["new"] + lines[51:120] + lines[122:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    second = op.remove_repeats(docs).where("doc_id = 1").first()
    assert second.removed_lines > 120 and "new" in second.text.split("\n")


def test_one_long_text(spark):
    text = "\n".join(f"{i % 997} some words" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in op.remove_repeats(docs).collect()}
    want = brute([(1, text), (2, text)])
    assert (got[2].text, got[2].removed_chunks, got[2].removed_lines) == want[2, text]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.remove_repeats(docs).collect() == [] and op.line_report(docs).collect() == []
