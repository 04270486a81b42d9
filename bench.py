"""Benchmark the headline queries.

Runs each query twice to warm up (after a JVM garbage collection), then
``BENCH_REPEATS`` timed runs (default 3),
each run executed in full with the no-op sink (no collect), and prints one
JSON line with the median seconds per query and their sum.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_REPEATS`` (default 3), ``BENCH_QUERIES`` (comma list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldcounts.plans.catalog import load_all  # noqa: E402
from fieldcounts.session import local_session  # noqa: E402

HEADLINE = [
    "a3_taxon_annual_mean",        # flagship slice: study day -> survey totals -> yearly mean
    "a6_baywide_counts",           # grouping sets, one pass
    "w2_cumulative_share",         # ranks and running shares
    "w4_daily_shares",             # shares of the day, rank within day
    "g4_yearly_share",             # two-level means + class
    "w6_attach_survey_numbers",    # survey calendar joined back to every record
    "a24_effort_comparison",       # effort subsets in one pass + right join
    "r10_derive_observations",     # unpivot + global sequence (range shuffle)
    "w8_duplicate_records",        # key counts joined back
    "m1_linear_trend",             # grouped regression
    "x1_keyword_notes",            # whole-text search
    "a27_notes_per_date",          # per-date note digests
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus)
    reg = load_all()
    timings = {}
    jvm = spark.sparkContext._jvm
    for name in names:
        build = reg[name].build
        jvm.System.gc()   # start each query from a collected heap, so earlier queries' garbage is not billed
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 4),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus),
                      "spark": spark.version, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
