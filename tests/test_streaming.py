"""Streaming classification equals the batch operator and resumes from its
checkpoint without reprocessing."""

import pytest

from ridelens.operators.keywords import classify_reviews
from ridelens.plans.registry import _reviews_with_time
from ridelens.session import new_scratch_path
from ridelens.sources.fixtures import fixture_tables
from ridelens.streaming import classify_review_files
from tests.conftest import SF_SMALL, canon


def test_stream_matches_batch_and_resumes(spark):
    reviews = _reviews_with_time(fixture_tables(spark, SF_SMALL))
    src, sink, ckpt = (new_scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    first, second = reviews.randomSplit([0.5, 0.5], seed=3)
    first.write.parquet(src, mode="append")
    q = classify_review_files(spark, src, reviews.schema, sink, checkpoint=ckpt)
    q.awaitTermination(300)
    assert spark.read.parquet(sink).count() == first.count()
    second.write.parquet(src, mode="append")
    q = classify_review_files(spark, src, reviews.schema, sink, checkpoint=ckpt)
    q.awaitTermination(300)
    # a start without new files adds nothing
    classify_review_files(spark, src, reviews.schema, sink, checkpoint=ckpt).awaitTermination(300)
    got = spark.read.parquet(sink)
    assert canon(got.collect()) == canon(classify_reviews(reviews).collect())


def test_checkpoint_must_be_named(spark):
    with pytest.raises(TypeError):
        classify_review_files(spark, "src", "review STRING", "sink")
