import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from ridelens.llm import risk_quality as op

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, m STRING, kept STRING, n_words STRING"
BLANKS = r"[\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(BLANKS, text) if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.sub(BLANKS, "", x)]
    n, r = len(words), len(repeated)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), r, n < 10 or 100 * r > 20 * n)


def random_text(rng):
    vocabulary = ["a", "b", "é", "日本", "#x", "|", "c\td", "e\x0b", "f\n", "a b\n", "\n", "\x85", "z\xa0y"]
    return " ".join(rng.choice(vocabulary[:rng.randrange(2, 14)]) for _ in range(rng.randrange(60)))


def test_measures_against_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "a b c d e a b c d e", "a a a a a a a"] + [random_text(rng) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None, "m", "k", "n") for i, t in enumerate(texts)] + [
        (3, texts[3], None, "m", "k", "n")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    got = op.quality_report(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:7] == want, texts[r.doc_id]
        assert r.kept == (not want[-1])
    assert op.quality_report(docs.limit(0), labels).collect() == []


def test_windows_without_collisions_in_a_long_text():
    words = [str(i).encode() for i in range(100_000)]
    assert op.repeated_words(words) == 0
    assert op.repeated_words(words + words[500:507]) == 14
    assert op.repeated_words(words[:5]) == 0 and op.repeated_words([b"a"] * 6) == 6


def exact_tail(n, k, p):
    p = Fraction(p)
    return sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n,k", [(1, 0), (10, 0), (40, 3), (200, 7), (300, 299), (5, 5)])
def test_exact_binomial_bounds(n, k):
    for p in (Fraction(1, 100), Fraction(1, 10), Fraction(1, 2)):
        assert op.binomial_tail(n, k, float(p)) == pytest.approx(float(exact_tail(n, k, p)), rel=1e-9)


def test_choice_takes_the_lowest_certified_cutoff_of_each_stratum():
    rules = {"r": (0.1, 0.2, 0.3), "s": (1.0,)}
    counts = {"big": {"n": 3000, "r": [400, 5, 0], "s": [0]}, "small": {"n": 60, "r": [0, 0, 0], "s": [0]}}
    chosen = op.choose(counts, risk=.01, error=.05, rules=rules)
    assert chosen == {"big": {"r": 0.2, "s": 1.0}, "small": {}}
    tests = 8
    assert exact_tail(3000, 5, Fraction(1, 100)) <= Fraction(5, 100) / tests
    assert op.choose({}, rules=rules) == {}


def test_chosen_cutoffs_keep_their_promise():
    """Over many random holdouts, a rate above the risk is certified at most at the error rate."""
    rng, failures = random.Random(1), 0
    for _ in range(300):
        rejected = sum(rng.random() < .06 for _ in range(400))
        failures += op.certified(400, rejected, .05, .05)
    assert failures <= 300 * .05 * 1.8


def test_calibrated_on_labels(spark):
    rng = random.Random(2)
    rows, told = [], []
    for i in range(3000):
        good, lang = i % 4 != 0, "xx" if i % 2 else None
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(20)]
        words += [f"#${rng.randrange(10 ** 6)}%&" for _ in range(rng.randrange(8, 20) if not good else rng.random() < .1)]
        rows.append((i, " ".join(words), lang, "m", "k", "n"))
        told.append((i, int(good)))
    told += [(None, 1), (0, 1), (4, 5), (8, None)]
    rows.append((9000, rows[0][1], "unseen", "m", "k", "n"))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(told, "doc_id BIGINT, quality INT")
    got = {r.doc_id: r for r in op.quality_report(docs, labels, risk=.02).collect()}
    good = [got[i].kept for i in range(3000) if i % 4 != 0]
    bad = [got[i].kept for i in range(3000) if i % 4 == 0]
    assert sum(good) >= .98 * len(good) and sum(bad) < .1 * len(bad)
    assert got[9000].kept and not got[0].kept


def test_sequences_keep_their_promise_in_every_group():
    """Strata, bands and all documents together: in few of many random holdouts is any chosen
    cutoff's true rate of false rejections, in the group it was certified in, above the risk."""
    rng = np.random.default_rng(5)
    grid = {rule: len(cutoffs) for rule, cutoffs in op.RULES.items()}
    strata = {f"{band}:{lang}": int(n) for (band, lang), n in
              zip([(b, g) for b in range(3) for g in "xyz"], rng.integers(40, 1500, 9))}
    # true rejection rates fall along each grid and cross the risk somewhere
    truth = {name: {rule: np.sort(rng.uniform(0, 0.04, size))[::-1] * rng.uniform(0, 1) for rule, size in grid.items()}
             for name in strata}
    broken, used = 0, 0
    for _ in range(60):
        counts = {}
        for name, n in strata.items():
            # a document's measure is one number a rule: rejected by all cutoffs below it
            draws = {rule: rng.uniform(size=n) for rule in grid}
            counts[name] = {"n": n, **{rule: [int((draws[rule] < p).sum()) for p in truth[name][rule]] for rule in grid}}
        own = op.choose(counts, op.RISK, op.ERROR * op.SHARES[0])
        bands = {}
        for name in strata:
            bands.setdefault(name[0], []).append(name)
        of_band = op.choose({b: op._pooled([counts[n] for n in names]) for b, names in bands.items()},
                            op.RISK, op.ERROR * op.SHARES[1])
        of_all = op.choose_in_turn(op._pooled(list(counts.values())), op.RISK, op.ERROR * op.SHARES[2])
        assert op.choose_backed(counts) == {n: of_all | of_band[n[0]] | own[n] for n in strata}

        def rate(names, rule, cutoff):
            k = op.RULES[rule].index(cutoff)
            return sum(strata[n] * truth[n][rule][k] for n in names) / sum(strata[n] for n in names)

        rates = [rate([n], r, c) for n in strata for r, c in own[n].items()]
        rates += [rate(bands[b], r, c) for b in bands for r, c in of_band[b].items()]
        rates += [rate(list(strata), r, c) for r, c in of_all.items()]
        used += len(rates) > 0
        broken += any(r > op.RISK for r in rates)
    assert used == 60 and broken <= 60 * op.ERROR + 4


def test_thin_strata_take_the_cutoffs_of_the_larger_group():
    clean = {rule: [0] * len(cutoffs) for rule, cutoffs in op.RULES.items()}
    counts = {"0:en": {"n": 5000, **clean}, "0:xx": {"n": 3, **clean}, "1:xx": {"n": 2, **clean}}
    found = op.choose_backed(counts)
    strictest = {rule: cutoffs[0] for rule, cutoffs in op.RULES.items()}
    assert found == dict.fromkeys(counts, strictest)
    assert op.choose_backed({"0:en": {"n": 50, **clean}}) == {"0:en": {}} and op.choose_backed({}) == {}


def test_decides_at_the_small_scale(spark):
    """At the scale of the correctness run the method itself rejects documents."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    found = op.quality_report(docs, labels)
    assert found.where("NOT base_failed AND NOT kept").count() > 0


def test_strata_of_any_number_have_cutoffs(spark):
    """A document of every one of 2,100 rare languages is rejected by its band's cutoffs."""
    clean = " ".join(f"word{i}" for i in range(20))
    rows = [(i, clean, "en", "m", "k", "n") for i in range(800)]
    rows += [(1000 + i, clean, f"l{i:04}", "m", "k", "n") for i in range(2100)]
    told = [(r[0], 1) for r in rows]
    dirty = clean + "".join(f" #$%&|<>{i}" for i in range(20))
    rows += [(9000 + i, dirty, f"l{i:04}", "m", "k", "n") for i in range(2100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = op.quality_report(docs, spark.createDataFrame(told, "doc_id BIGINT, quality INT")).collect()
    assert len(got) == len(rows)
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {d for d, _ in told}
