"""Benchmark the headline queries.

Runs each query fully (``noop`` sink, so nothing is collected to the
driver) at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retentio.plans.registry import QUERIES  # noqa: E402
from retentio.session import get_session  # noqa: E402

HEADLINE = (
    # cleaning / profiling
    "customer_360", "clean_customers", "churn_by_tenure_group", "null_counts",
    "describe", "describe_lineitem", "value_counts_lineitem", "histogram_lineitem",
    "kde", "corr_matrix", "count_distinct", "eda_report",
    # statistics and decisions
    "chi2_scan", "chi2_tests", "profit_curve", "profit_threshold", "eval_metrics",
    "roc_auc", "top_n_scored", "abc_assign", "abc_readout", "impute_conditional",
    "soft_vote", "knn_score",
)
# model fitting, explanation and streaming (slower, fixed-cost dominated)
OPTIONAL = ("tune", "explain_local", "stream_score")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    names = [n for n in HEADLINE + OPTIONAL if n in QUERIES]
    # warm-up: JVM, parquet footers, Python workers (not timed)
    QUERIES["customer_360"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))


if __name__ == "__main__":
    main()
