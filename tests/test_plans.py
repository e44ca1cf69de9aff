"""Plan checks: no Python in the plan, no cartesian products, the LEFT JOIN
turned inner by its WHERE, pruning and pushdown into Parquet, and the text
search evaluated once per row."""

import re

import pytest

from ridelens.operators import funnel, segments
from ridelens.plans.registry import QUERIES
from ridelens.session import new_scratch_path
from ridelens.sources.tables import load_parquet_tables
from tests.conftest import SF_SMALL, canon

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_or_cartesian(spark, key):
    plan = executed(QUERIES[key](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in plan, (key, node)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_forced_repartition_or_broadcast(spark, key):
    query = QUERIES[key](spark, SF_SMALL)
    assert "REPARTITION" not in executed(query), key
    assert "strategy=broadcast" not in optimized(query), key


def test_distinct_counts_do_not_expand_the_rides(spark):
    plan = executed(QUERIES["count_distinct_global"](spark, SF_SMALL))
    assert "Expand" not in plan


def test_review_text_and_counts_stay_out_of_joins(spark):
    """Ride ids are unique here, so counting needs no join of the reviews to the rides
    (one join makes the reviews themselves)."""
    for key in ("keyword_counts", "top_keywords", "flag_value_counts"):
        assert optimized(QUERIES[key](spark, SF_SMALL)).count("Join ") == 1, key


def test_profile_reads_whole_texts(spark):
    """The profile is handed the reviews as they are, no part of them."""
    assert "substring" not in optimized(QUERIES["profile_reviews"](spark, SF_SMALL)).lower()


def test_filtered_left_join_becomes_inner(spark):
    plan = optimized(QUERIES["rides_paid"](spark, SF_SMALL))
    assert "Join Inner" in plan


def test_scans_read_only_needed_columns(spark):
    plan = executed(QUERIES["filter_approved"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,"
                       "l_returnflag:string>"]


def test_text_search_runs_once_per_row(spark):
    for key in ["classified_reviews", "sentiment_rollup", "flag_value_counts"]:
        plan = optimized(QUERIES[key](spark, SF_SMALL))
        assert plan.count("Contains(") == 84, key


@pytest.fixture(scope="module")
def parquet_tables(spark):
    """The fixture views written once as real Parquet tables."""
    from ridelens.sources.fixtures import fixture_tables
    root = new_scratch_path(spark, "funnel-tables")
    for name, df in fixture_tables(spark, SF_SMALL).items():
        df.write.parquet(f"{root}/{name}")
    return load_parquet_tables(spark, root)


def test_stage_filters_reach_parquet(parquet_tables):
    plan = executed(segments.ux_accepted(parquet_tables))
    assert "IsNotNull(accept_ts)" in plan
    plan = executed(segments.rx_paid(parquet_tables))
    assert "EqualTo(charge_status,Approved)" in plan
    assert "IsNotNull(dropoff_ts)" in plan


def test_results_equal_on_parquet_tables(spark, parquet_tables):
    from ridelens.sources.fixtures import fixture_tables
    views = fixture_tables(spark, SF_SMALL)
    for op in (funnel.user_funnel, segments.ride_extract, segments.user_extract):
        assert canon(op(parquet_tables).collect()) == canon(op(views).collect())


def test_command_line_runs_on_parquet_tables(spark, parquet_tables):
    from ridelens.__main__ import main
    root = new_scratch_path(spark, "funnel-tables-cli")
    from ridelens.sources.fixtures import fixture_tables
    for name, df in fixture_tables(spark, SF_SMALL).items():
        df.write.parquet(f"{root}/{name}")
    out = new_scratch_path(spark, "cli-out")
    main(["user_funnel", "--tables", root, "--out", out])
    assert spark.read.parquet(out).count() == 7
    for extra, rows in (([], spark.read.parquet(f"{root}/reviews").count()), (["--n", "9", "--seed", "x"], 9)):
        out = new_scratch_path(spark, "cli-sample")
        main(["review_sample", "--tables", root, "--out", out, *extra])
        assert spark.read.parquet(out).count() == rows


def test_hot_user_is_split_or_pre_aggregated(spark):
    """A user with a third of the rides: the ride extract's join is split by
    AQE (its aggregate is keyed by ride), the user extract sums rides per user
    before joining (its aggregate reuses the user_id partitioning)."""
    from tests.test_worlds import skewed_world
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        w = skewed_world(spark, rides=30000, users=300)
        rx = segments.rx_ride_stages(w)
        rx.collect()
        assert "SortMergeJoin(skew=true)" in executed(rx)
        ux = segments.ux_ride_stages(w)
        ux.collect()
        plan = optimized(ux)
        join = plan.index("Join LeftOuter, (user_id")
        assert re.search(r"Aggregate \[user_id#\d+L\]", plan[join:])
        # a ride id with a third of the reviews: the reviews-rides join is split
        from ridelens.plans.registry import BUILDERS
        for key in ("sentiment_rollup", "classified_reviews", "keyword_counts"):
            df = BUILDERS[key](w)
            df.collect()
            assert "SortMergeJoin(skew=true)" in executed(df), key
        review_stage = segments.ux_review(w)
        review_stage.collect()
        assert "SortMergeJoin(skew=true)" in executed(review_stage)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
