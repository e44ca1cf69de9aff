"""Randomised checks of the expression helpers against plain Python
(fixed seeds; one Spark job per check)."""

import datetime as dt
import random
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ridelens.functions.numeric import round_mean_half_up
from ridelens.functions.text import any_phrase, phrase_occurrences
from ridelens.functions.time import minute_field

PHRASES = ["rude", "incorrect", "safe", "Great service!", "go-to", "knowledgeable", "aa"]
# letters of the phrases in both cases, the non-ASCII letters that fold onto
# ASCII ones, other non-ASCII letters, punctuation and blanks
ALPHABET = list("rudeincotsafgGRSEVICk!-o aAzZ\n") + ["ſ", "K", "İ", "ı", "é", "ß", "Σ", "ﬀ"]


def random_texts(n, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.5:          # plant a phrase, possibly in odd case
            p = rng.choice(PHRASES)
            p = "".join(ch.upper() if rng.random() < 0.5 else ch for ch in p)
            k = rng.randint(0, len(s))
            s = s[:k] + p + s[k:]
        texts.append(s)
    special = ["ıncorrect", "İNCORRECT", "ınCORRECT", "ſafe", "SAſE", "\u212anowledgeable",
               "go-TO", "great SERVICE!", "aaaa", "ss", "SS"]
    return texts + special + [None, ""]


def test_phrase_search_matches_python_ignorecase(spark):
    texts = random_texts(2000, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = df.select("i", *[any_phrase("t", [p]).alias(f"f{j}") for j, p in enumerate(PHRASES)],
                    any_phrase("t", PHRASES).alias("f_any")).collect()
    for r in got:
        text = texts[r.i]
        for j, p in enumerate(PHRASES):
            want = int(text is not None and re.search(re.escape(p), text, re.IGNORECASE) is not None)
            assert r[f"f{j}"] == want, (text, p)
        want_any = int(text is not None and
                       re.search("|".join(map(re.escape, PHRASES)), text, re.IGNORECASE) is not None)
        assert r.f_any == want_any, text


def test_phrase_counts_match_python_count(spark):
    texts = random_texts(2000, 2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    low = df.select("i", F.lower("t").alias("t"))
    got = low.select("i", *[phrase_occurrences("t", p).alias(f"c{j}")
                            for j, p in enumerate(PHRASES)]).collect()
    for r in got:
        text = texts[r.i]
        for j, p in enumerate(PHRASES):
            want = 0 if text is None else text.lower().count(p)
            assert r[f"c{j}"] == want, (text, p)


def test_rounded_mean_is_exact_half_up(spark):
    rng = random.Random(3)
    cases = [(rng.randint(-10**6, 10**6), rng.randint(1, 2000)) for _ in range(2000)]
    cases += [(1, 8), (-1, 8), (3, 8), (-3, 8), (67, 200), (-67, 200), (0, 5), (-1, 400), (5, 0)]
    df = spark.createDataFrame(cases, "s BIGINT, c BIGINT")
    got = df.select("s", "c", round_mean_half_up(F.col("s"), F.col("c")).alias("r")).collect()
    for r in got:
        if r.c == 0:
            assert r.r is None
            continue
        exact = (Decimal(r.s) / Decimal(r.c)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert r.r == float(exact), (r.s, r.c)
        assert str(r.r) != "-0.0"


def test_minute_field_matches_interval_semantics(spark):
    rng = random.Random(4)
    base = dt.datetime(2022, 3, 1, 12, 0, 0)
    cases = [(base, base + dt.timedelta(seconds=rng.randint(-3 * 86400, 3 * 86400)))
             for _ in range(2000)]
    df = spark.createDataFrame(cases, "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    for r in df.select("a", "b", minute_field("b", "a").alias("m")).collect():
        secs = int((r.b - r.a).total_seconds())
        sign = -1 if secs < 0 else 1
        assert r.m == sign * ((abs(secs) // 60) % 60), (r.a, r.b)
