"""Properties over the driver tables: independence of time zone and of the
partition count, sample shape, extract totals versus funnel counts."""

from pyspark.sql import functions as F

from ridelens.operators import funnel, sampling, segments
from ridelens.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL, canon


def test_time_zone_does_not_matter(spark):
    t = fixture_tables(spark, SF_SMALL)
    base = canon(segments.user_extract(t).collect())
    ride = canon(segments.ride_extract(t).collect())
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert canon(segments.user_extract(t).collect()) == base
        assert canon(segments.ride_extract(t).collect()) == ride
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_partition_count_does_not_matter(spark):
    t = fixture_tables(spark, SF_SMALL)
    base = canon(segments.ride_extract(t).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert canon(segments.ride_extract(t).collect()) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sample_is_a_duplicate_free_subset(spark):
    t = fixture_tables(spark, SF_SMALL)
    total = t["reviews"].count()
    src = sampling.reviews_for_sample(t["reviews"], t["ride_requests"], 42)
    for n in (10, total, total + 5):
        got = sampling.review_sample(t["reviews"], t["ride_requests"], n=n, seed=42)
        assert got.count() == min(n, total)
        assert got.exceptAll(src.select(*sampling.SAMPLE_COLUMNS)).count() == 0
        assert got.distinct().count() == got.count()


def test_extract_totals_cover_funnel_counts(spark):
    t = fixture_tables(spark, SF_SMALL)
    fun = {r.funnel_name: r.user_count for r in funnel.user_funnel(t).collect()}
    ext = {r.funnel_step: r.total for r in segments.user_extract(t)
           .groupBy("funnel_step").agg(F.sum("user_count").alias("total")).collect()}
    pairs = {1: "app_downloads", 2: "signups", 3: "ride_requested", 4: "ride_accepted",
             6: "approved_transaction", 7: "reviewed"}
    for step, name in pairs.items():
        assert ext[step] >= fun[name], name


def test_declared_base_schemas_match_files(spark):
    import os

    from pyspark.sql.types import StructType

    from ridelens.sources.fixtures import BASE_SCHEMAS
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        for name, ddl in BASE_SCHEMAS.items():
            stored = spark.read.parquet(os.path.join("/root/testdata", sf, f"{name}.parquet"))
            for field in StructType.fromDDL(ddl).fields:
                assert stored.schema[field.name].dataType == field.dataType, (sf, name, field)


def test_parquet_loader_and_profiles(spark):
    from ridelens.sources.profile import profile
    from ridelens.sources.tables import load_parquet_tables, table_row_counts
    t = load_parquet_tables(spark, SF_SMALL, names=("customer", "orders"))   # <name>.parquet
    counts = {r.table_name: r.row_count for r in table_row_counts(t).collect()}
    assert counts == {"customer": 150, "orders": 1500}
    prof = {r.column: (r.dtype, r.non_null, r.total) for r in profile(t["customer"]).collect()}
    assert prof["c_custkey"] == ("bigint", 150, 150)
    assert set(prof) == set(t["customer"].columns)


def test_session_takes_static_settings(spark):
    from ridelens.session import get_session
    again = get_session(conf={"spark.sql.warehouse.dir": "/tmp/elsewhere", "spark.sql.shuffle.partitions": "8"})
    assert again.conf.get("spark.sql.shuffle.partitions") == "8"
