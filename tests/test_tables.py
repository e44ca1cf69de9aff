"""Loading the tables: either file name on any file system, partitions as the caller says."""

import pytest

from ridelens.plans.registry import BUILDERS
from ridelens.sources.fixtures import fixture_tables
from ridelens.sources.tables import load_parquet_tables
from tests.conftest import SF_SMALL, canon


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_both_names_are_found_through_the_file_system(spark, tmp_path, scheme):
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    spark.range(5).write.parquet(f"{tmp_path}/suffixed.parquet")
    t = load_parquet_tables(spark, f"{scheme}{tmp_path}", names=("plain", "suffixed"))
    assert (t["plain"].count(), t["suffixed"].count()) == (3, 5)


def test_partitions_are_the_callers(spark):
    """Named tables are dealt out, others stay as stored; the rows are the same."""
    t = load_parquet_tables(spark, SF_SMALL, names=("orders", "customer"), partitions={"orders": 6})
    assert t["orders"].rdd.getNumPartitions() == 6
    assert "Repartition" not in t["customer"]._jdf.queryExecution().optimizedPlan().toString()
    plain, dealt = fixture_tables(spark, SF_SMALL), fixture_tables(spark, SF_SMALL, {"documents": 5})
    for key in ("sentiment_rollup", "top_keywords"):
        assert canon(BUILDERS[key](plain).collect()) == canon(BUILDERS[key](dealt).collect())
