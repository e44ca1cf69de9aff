import hashlib
import random
import re
from collections import Counter

import pytest

from ridelens.llm import curriculum_mix as op

SCHEMA = "doc_id BIGINT, text STRING, source STRING, size STRING, row INT, bucket INT, s INT"


def brute_targets(sizes, weights=op.WEIGHTS, limit=3):
    """Share by weight, stop at the limit, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / shares for s in free}
        above = [s for s in free if share[s] > limit * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in above}


def make_rows(rng, n=120):
    sources = ["b", "a", None, "é", "Z", "tiny"]
    rows = []
    for i in range(n):
        source = "b" if i % 3 == 0 else "tiny" if i == 1 else rng.choice(sources[:5])
        text = rng.choice([None, "", " ".join(["w"] * rng.randrange(40)), "one\ttwo\x0bthree x"])
        rows.append((None if i == 7 else i // 2, text, source, "s", 1, 2, 3))
    return rows


@pytest.mark.parametrize("bucket_rows", [20_000, 2])
def test_against_brute_force(spark, bucket_rows):
    rows = make_rows(random.Random(6))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    targets = brute_targets(sizes)
    mixed = op.mix(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows)
    assert [c for c in mixed.columns if c not in op.OUTPUTS] == ["doc_id", "text", "source", "row", "bucket", "s"]
    got = mixed.collect()
    assert len(got) == len(rows)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    start = {}
    for r in sorted(got, key=lambda r: (md5("" if r.doc_id is None else str(r.doc_id)), md5(r.text or ""))):
        c = start.get(r.source, 0)
        start[r.source] = c + r.size
        assert r.size == count(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        words = [max(0, min(r.size, int(r.target) - e * sizes[r.source] - c)) for e in range(3)]
        assert r.taken == sum(words) <= 3 * r.size
        assert [(o.epoch, o.words) for o in r.occurrences] == [(e, w) for e, w in enumerate(words) if w]
    for s in sizes:
        assert sum(r.taken for r in got if r.source == s) == int(next(r.target for r in got if r.source == s))


@pytest.mark.parametrize("schedule", op.SCHEDULES)
def test_position_inverts_the_integral(spark, schedule):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "share DOUBLE")
    from pyspark.sql import functions as F
    times = [r.t for r in df.select("share", op.position(F.col("share"), schedule).alias("t"))
             .orderBy("share").collect()]
    assert times == sorted(times) and times[0] == 0 and times[-1] == pytest.approx(1)

    def weight(u):
        for (a, x), (b, y) in zip(schedule, schedule[1:]):
            if u <= b:
                return x + (y - x) * (u - a) / (b - a)
    steps = 4000
    total = sum(weight((k + .5) / steps) for k in range(steps)) / steps
    for share, t in list(zip(shares, times))[::7]:
        area = sum(weight(t * (k + .5) / steps) for k in range(steps)) * t / steps
        assert area == pytest.approx(share * total, abs=1e-4)


def test_arranged_by_position(spark):
    docs = spark.createDataFrame(make_rows(random.Random(7), 300), SCHEMA)
    rows = op.arrange(op.mix(docs, bucket_rows=9)).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and all(0 <= p < 1 for p in at)
    assert [tuple(r) for r in rows] == [tuple(r) for r in op.arrange(op.mix(docs)).collect()]
    # the first weight class rises over time, the third falls
    early = [r.source for r in rows[:len(rows) // 2]]
    late = [r.source for r in rows[len(rows) // 2:]]
    assert early.count("Z") < late.count("Z") and early.count("b") > late.count("b")


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id BIGINT, text STRING, source STRING")
    assert sorted(map(tuple, op.mix_report(docs).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert op.arrange(op.mix(docs)).collect() == []
    assert op.mix_report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("range_bytes", [10 ** 9, 900, 60])
def test_training_order_is_arrange_of_mix(spark, range_bytes):
    rows = make_rows(random.Random(8), 200) + [(3, "a b c d e", "a", f"s{i % 5}", i % 2, 2, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = op.arrange(op.mix(docs))
    got = op.training_order(docs, bucket_rows=9, range_bytes=range_bytes)
    assert got.columns == want.columns
    got, want = got.collect(), want.collect()
    # documents of equal id and text may change places with each other
    apart = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.source or "-", r.epoch, r.words,
                                  r.position, r.size, r.source_size, r.target, r.taken) for r in rows))
    assert apart(got) == apart(want)
    held = Counter((*r[:3], *r[4:]) for r in rows)
    for epoch in range(3):
        read = Counter(tuple(r[:6]) for r in got if r.epoch == epoch)
        assert not read - held
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_training_order_shuffles_texts_once(spark, capsys):
    docs = spark.createDataFrame(make_rows(random.Random(9)), SCHEMA)
    op.training_order(docs).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1, plan


def test_training_order_of_no_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id BIGINT, text STRING, source STRING")
    assert op.training_order(docs).collect() == [] == op.training_order(docs.limit(0)).collect()
