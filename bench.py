"""Headline-query timings at $BENCH_SF_DIR (default /root/testdata/sf0.1).

Protocol: local[$BENCH_CPUS], AQE on, UI off; per query one warm-up run, then
the median of $BENCH_REPEATS (default 5) runs, each forced with the ``noop`` sink (full
execution, nothing collected). ``documents`` is one row group, so one task would read
and search all texts: it is dealt out to $BENCH_TEXT_PARTITIONS (default: the CPUs)
partitions, a caller's parameter; 0 leaves it as stored. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridelens.plans.registry import BUILDERS  # noqa: E402
from ridelens.session import get_session  # noqa: E402
from ridelens.sources.fixtures import fixture_tables  # noqa: E402

HEADLINE = ["user_funnel", "ride_funnel", "user_extract", "ride_extract", "review_sample",
            "classified_reviews", "top_keywords", "sentiment_rollup"]


def build(spark, key, sf_dir, parts):
    return BUILDERS[key](fixture_tables(spark, sf_dir, {"documents": parts} if parts else None))


def run_once(spark, key, sf_dir, parts):
    t0 = time.perf_counter()
    build(spark, key, sf_dir, parts).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(os.environ.get("BENCH_TEXT_PARTITIONS", cpus))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    keys = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", app_name="ridelens-bench", conf={
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(int(cpus) * 2)),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    timings, builds = {}, {}
    for key in keys:
        run_once(spark, key, sf_dir, parts)  # warm-up: JIT, file listing, codegen caches
        timings[key] = round(statistics.median(run_once(spark, key, sf_dir, parts)
                                               for _ in range(repeats)), 3)
        t0 = time.perf_counter()
        build(spark, key, sf_dir, parts)   # DataFrame construction alone (driver side)
        builds[key] = round(time.perf_counter() - t0, 3)
        print(f"# {key}: {timings[key]}s (build {builds[key]}s)", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds",
                      "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": int(cpus),
                      "text_partitions": parts,
                      "build_sec": builds}))


if __name__ == "__main__":
    main()
