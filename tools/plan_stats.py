"""Per-query physical-plan summary: exchanges (shuffles), broadcasts, scans per
table and Python UDF nodes, as a markdown table (initial adaptive plan).

Usage: python tools/plan_stats.py [sf_dir] > PLANS.md
Queries that run a job while being built (fits, streams, writes) are listed
with their final plan only.
"""
from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vintage.plans import catalog  # noqa: E402
from vintage.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("plans")
    print("| query | shuffles | broadcasts | scans | python nodes |")
    print("|---|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        try:
            df = fn(spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} | | | |")
            continue
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
        bcast = plan.count("BroadcastExchange")
        scans = Counter(m for m in re.findall(r"/([a-z_]+)\.parquet", plan))
        py = len(re.findall(r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan))
        sc = ", ".join(f"{t}×{n}" for t, n in sorted(scans.items())) or "(written table)"
        print(f"| {name} | {shuffles} | {bcast} | {sc} | {py} |")


if __name__ == "__main__":
    main()
