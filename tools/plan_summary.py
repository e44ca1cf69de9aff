"""Write PLANS.md: for each headline query, the executed (final AQE) plan's
exchanges, joins and scans, plus the full formatted plan.

Usage: python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ridelens.plans.registry import QUERIES  # noqa: E402
from ridelens.session import get_session  # noqa: E402


def summarize(plan: str) -> dict[str, int]:
    return {
        "shuffle exchanges": len(re.findall(r"\bExchange hashpartitioning|\bExchange "
                                            r"rangepartitioning|\bExchange SinglePartition|"
                                            r"\bExchange RoundRobin", plan)),
        "reused exchanges": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "broadcast hash joins": plan.count("BroadcastHashJoin"),
        "parquet scans": plan.count("FileScan parquet"),
        "python nodes": len(re.findall(r"EvalPython|InPandas|PythonUDF", plan)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "16"})
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans of the headline queries", "",
           f"Final adaptive plans after one run at `{sf_dir}` on `local[8]`, "
           "16 shuffle partitions. Generated by `tools/plan_summary.py`.", ""]
    details = []
    rows = []
    for key in HEADLINE:
        df = QUERIES[key](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]          # final adaptive plan only
        plan = "\n".join(line if len(line) <= 220 else line[:217] + "..."
                         for line in plan.splitlines())
        s = summarize(plan)
        rows.append(f"| `{key}` | " + " | ".join(str(v) for v in s.values()) + " |")
        details += [f"## {key}", "", "```", plan.strip(), "```", ""]
    cols = list(summarize("").keys())
    out += ["| query | " + " | ".join(cols) + " |", "|---" * (len(cols) + 1) + "|", *rows, ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(out + details))


if __name__ == "__main__":
    main()
