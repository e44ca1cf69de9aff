"""One-pass phrase counting: any phrases, overlapping and self-overlapping ones included."""

import random
import re

import pytest

from ridelens.functions.trie import doubles, trie_pattern
from ridelens.operators import keywords


def as_dictionary(phrases):
    return {"a": {"s": list(phrases)}}


def counts(spark, texts, phrases):
    df = spark.createDataFrame([(t,) for t in texts], "review STRING")
    return {r.phrase: r.n for r in keywords.keyword_counts(df, dictionary=as_dictionary(phrases)).collect()}


def test_pattern_takes_the_longest_phrase_at_every_place():
    phrases = ["late", "later", "at", "a", "t.e"]
    found = [m[1] for m in re.finditer(trie_pattern(phrases), "later t.e txe")]
    assert found == ["later", "at", "t.e"]


@pytest.mark.parametrize("phrase, expected", [
    ("abab", ["ababab"]), ("aa", ["aaa"]), ("abc", []), ("aba", ["ababa"]), ("aaa", ["aaaaa", "aaaa"]), ("x", [])])
def test_doubles(phrase, expected):
    assert doubles(phrase) == expected


@pytest.mark.parametrize("seed", range(6))
def test_counts_equal_python_on_a_small_alphabet(spark, seed):
    """Two or three letters: nearly every phrase is a prefix, part or double of another."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "ab "
    phrases = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(25)})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    got = counts(spark, texts, phrases)
    assert got == {p: sum(t.count(p) for t in texts if t) for p in phrases}


def test_characters_with_a_meaning_in_patterns(spark):
    phrases = ["a.b", "[x]", "^", "-", "a\\b", "(", "$ 5", "&&", "]", "é", "日本", "日", "😀x"]
    texts = ["a.b axb [x] ^-^ a\\b ($ 5 && ]", "É é 日本日 😀x😀", "a.b" * 3]
    got = counts(spark, texts, phrases)
    assert got == {p: sum(t.lower().count(p) for t in texts) for p in phrases}


def test_whole_long_text(spark):
    text = "the ride was late. " * 200_000 + "disinterestedisinterested"
    got = counts(spark, [text], ["late", "disinterested", "interested", "ride was"])
    assert got == {"late": 200_000, "disinterested": 1, "interested": 2, "ride was": 200_000}


@pytest.mark.parametrize("phrases", [[], ["a", ""]])
def test_empty_phrases_are_refused(phrases):
    with pytest.raises(ValueError):
        trie_pattern(phrases)


def test_text_is_scanned_once(spark):
    """One pattern search a row, evaluated in one place of the plan."""
    df = spark.createDataFrame([("late",)], "review STRING")
    plan = keywords.keyword_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
