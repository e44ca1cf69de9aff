"""Run one registered query over the five funnel tables and write the result.

    spark-submit --py-files ridelens.zip ridelens/__main__.py user_extract \
        --tables s3://.../funnel --out s3://.../x
    python -m ridelens ride_extract --tables /data/funnel --out /tmp/x --format csv

``--tables`` holds one Parquet folder (or file) per table name. The write is
distributed (one file per partition).
"""

from __future__ import annotations

import argparse

from ridelens.operators.sampling import REFERENCE_SAMPLE_SIZE, review_sample
from ridelens.plans.registry import BUILDERS
from ridelens.session import get_session
from ridelens.sources import csv as csv_io
from ridelens.sources.tables import load_parquet_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ridelens")
    parser.add_argument("query", choices=sorted(BUILDERS))
    parser.add_argument("--tables", required=True, help="folder with the five tables")
    parser.add_argument("--out", required=True, help="output folder")
    parser.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--mode", default="errorifexists")
    parser.add_argument("--n", type=int, default=REFERENCE_SAMPLE_SIZE,
                        help="reviews to draw (review_sample only)")
    parser.add_argument("--seed", default="42", help="seed of the draw (review_sample only)")
    parser.add_argument("--partitions", action="append", default=[], metavar="TABLE=N",
                        help="deal a table stored in too few row groups out to N tasks")
    args = parser.parse_args(argv)
    spark = get_session()
    partitions = {name: int(n) for name, n in (p.split("=") for p in args.partitions)}
    tables = load_parquet_tables(spark, args.tables, partitions=partitions)
    if args.query == "review_sample":
        df = review_sample(tables["reviews"], tables["ride_requests"], n=args.n, seed=args.seed)
    else:
        df = BUILDERS[args.query](tables)
    if args.format == "csv":
        csv_io.write_csv(df, args.out, mode=args.mode)
    else:
        df.write.mode(args.mode).parquet(args.out)


if __name__ == "__main__":
    main()
