"""Summarise the final (adaptive) physical plan of every registered query.

Usage: python tools/plan_report.py [--sf DIR] > PLANS.md

Counts shuffle exchanges by kind, broadcast exchanges, join strategies,
windows, Python evaluation nodes and the widest Parquet read schema.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldcounts.plans.catalog import load_all  # noqa: E402
from fieldcounts.session import local_session  # noqa: E402


def summarise(plan: str) -> dict:
    # an adaptive plan prints the final plan first, then the initial one
    plan = plan.split("== Initial Plan ==")[0]
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": len(re.findall(r"BroadcastExchange", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "bnlj": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "window": len(re.findall(r"\bWindow\b", plan)),
        "python": len(re.findall(r"FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)),
        "reused": len(re.findall(r"ReusedExchange", plan)),
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = local_session(8)
    reg = load_all()
    print("# Final physical plans of the registered queries\n")
    print(f"Scale: `{args.sf}`, local[8], AQE on. Generated by `tools/plan_report.py` after running each "
          "query (so adaptive re-planning is included). Columns count plan nodes: shuffles by partitioning "
          "(hash / range / single partition), broadcast exchanges, broadcast-hash and sort-merge joins, "
          "nested-loop or cartesian joins, window operators and Python (pandas) evaluation.\n")
    print("| query | hash | range | single | bcast | BHJ | SMJ | NLJ | window | python | reused |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for name, q in reg.items():
        df = q.build(spark, args.sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{name}` | {s['hash']} | {s['range']} | {s['single']} | {s['bcast']} | {s['bhj']} | {s['smj']} "
              f"| {s['bnlj']} | {s['window']} | {s['python']} | {s['reused']} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
