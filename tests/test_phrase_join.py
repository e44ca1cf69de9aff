"""Dictionaries as tables: the same hits, flags and labels as the expression form."""

import random

import pytest
from pyspark.sql import functions as F

from ridelens.operators import keywords, phrase_join
from ridelens.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL, canon


def table_of(spark, dictionary):
    return spark.createDataFrame([(a, s, p) for a, s, _, p in keywords.dictionary_rows(dictionary)],
                                 "aspect STRING, sentiment STRING, phrase STRING")


@pytest.fixture(scope="module")
def reviews(spark):
    return fixture_tables(spark, SF_SMALL)["reviews"].select("ride_id", "review")


def test_flags_equal_the_expression_form(spark, reviews):
    flagged = phrase_join.flags_by_table(reviews, table_of(spark, keywords.DEFAULT_DICTIONARY))
    assert flagged.columns == ["ride_id", "review", "aspect", "sentiment"]
    got = {(r.ride_id, f"{r.aspect}_{r.sentiment}") for r in flagged.collect()}
    wide = keywords.keyword_flags(reviews).collect()
    assert got == {(r.ride_id, c) for r in wide for c in keywords.flag_columns() if r[c]}


def test_labels_equal_the_expression_form(spark, reviews):
    found = phrase_join.labels_by_table(reviews, table_of(spark, keywords.DEFAULT_DICTIONARY))
    got = {r.ride_id: r.labels for r in found.collect()}
    for r in keywords.classify_reviews(reviews).collect():
        assert got[r.ride_id] == {a: r[a] for a in keywords.LABEL_ASPECTS if r[a]}


def hits(spark, texts, phrases, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "_row BIGINT, _text STRING").where("_text IS NOT NULL")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    return canon(phrase_join.phrase_hits(rows, table, **options).collect())


@pytest.mark.parametrize("seed", range(4))
def test_hits_equal_brute_force(spark, seed):
    """Short letters, so that phrases shorter than a gram, equal grams and line breaks occur."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    texts = [word(rng.randint(0, 80)) for _ in range(150)] + [None, "", "a"]
    phrases = [word(rng.randint(1, 9)) for _ in range(120)] + ["", None, "a", "a"]
    want = {(i, p) for i, t in enumerate(texts) if t for p in phrases if p and p in t}
    assert hits(spark, texts, phrases, share=0.3) == canon(want)


def test_sample_share_changes_no_result(spark):
    texts = ["the ride was late again", "late ride", "nothing", "the lateness of the ride"] * 5
    phrases = ["ride was", "late", "the ride", "lateness", "nothing at all"]
    assert hits(spark, texts, phrases, share=0.0) == hits(spark, texts, phrases, share=1.0)


def test_no_phrases_and_no_texts(spark):
    assert hits(spark, ["a b"], []) == [] == hits(spark, [], ["a b"]) == hits(spark, ["a b"], ["", None])


def test_counts_list_phrases_without_a_text(spark):
    texts = spark.createDataFrame([("Late ride",), ("LATE",), (None,)], "review STRING")
    phrases = spark.createDataFrame([("late",), ("Ride",), ("early",), ("late",)], "phrase STRING")
    got = phrase_join.phrase_counts(texts, phrases)
    assert canon(got.collect()) == canon([("late", 2), ("ride", 1), ("early", 0)])


def test_plan_does_not_grow_with_the_dictionary(spark, reviews):
    few = spark.range(10).select(F.concat(F.lit("phrase "), F.col("id")).alias("phrase"))
    many = spark.range(5000).select(F.concat(F.lit("phrase "), F.col("id")).alias("phrase"))
    size = [len(phrase_join.phrase_counts(reviews, p)._jdf.queryExecution().optimizedPlan().toString()) for p in (few, many)]
    assert abs(size[0] - size[1]) < 200


def test_only_grams_of_anchors_leave_a_text(spark):
    """The phrases and the texts' grams share words, but no text gives away more than it contains."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(300)]
    phrases = [" ".join(rng.choices(words, k=3)) for _ in range(1000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(50)] + phrases[:50]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row BIGINT, _text STRING")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    anchors, widths = phrase_join._anchors(table.distinct(), rows, 1.0)
    want = {(i, p) for i, t in enumerate(texts) for p in phrases if p in t}
    assert phrase_join.marked_grams(rows, anchors, widths).join(anchors, "gram").count() <= 3 * len(want)
    assert canon(phrase_join.phrase_hits(rows, table).collect()) == canon(want)


def test_grams_do_not_depend_on_the_blocks():
    body = "".join(random.Random(1).choice("abé ") for _ in range(500)).encode()
    for widths in [(1,), (5, 24), phrase_join.WIDTHS]:
        whole = phrase_join.grams_of(body, widths)
        assert whole.tolist() == phrase_join.grams_of(body, widths, block=7).tolist()
        assert len(whole) == len({(w, body[i:i + w]) for w in widths for i in range(len(body) - w + 1)})
    assert not len(phrase_join.grams_of(b"", (1, 24))) and not len(phrase_join.grams_of(b"abc", (5,)))
