"""Per-query job/stage counts and slowest stages from Spark's event log.

Usage: python tools/stage_times.py [sf_dir] query [query ...]
The event log goes to a fresh scratch folder (mktemp); the UI stays off.
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from pyspark.sql import SparkSession  # noqa: E402

from retentio.plans.registry import QUERIES  # noqa: E402
from retentio.session import ensure_checkpoint_dir  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")]
    logdir = tempfile.mkdtemp(prefix="run-events-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.dir", f"file://{logdir}")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    QUERIES["customer_360"](spark, sf).write.format("noop").mode("overwrite").save()
    walls = {}
    for n in names:
        spark.sparkContext.setJobDescription(n)
        t0 = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        walls[n] = time.perf_counter() - t0
    spark.sparkContext.setJobDescription(None)
    spark.stop()
    stage_job, job_query, stages = {}, {}, {}
    import os
    for path in glob.glob(f"{logdir}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                q = (e.get("Properties") or {}).get("spark.job.description")
                job_query[e["Job ID"]] = q
                for sid in e.get("Stage IDs", []):
                    stage_job[sid] = e["Job ID"]
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if "Completion Time" in si and "Submission Time" in si:
                    stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"],
                                              si["Stage Name"], si["Number of Tasks"])
    for n in names:
        jobs = [j for j, q in job_query.items() if q == n]
        st = [(sid, *stages[sid]) for sid, j in stage_job.items() if j in jobs and sid in stages]
        busy = sum(s[1] for s in st) / 1000
        print(f"{n}: wall {walls[n]:.2f}s, jobs {len(jobs)}, stages {len(st)}, "
              f"stage time {busy:.2f}s")
        for sid, ms, name, tasks in sorted(st, key=lambda s: -s[1])[:5]:
            print(f"    stage {sid:5d} {ms / 1000:6.2f}s tasks={tasks:4d} {name[:70]}")
    print(f"event log: {logdir}")


if __name__ == "__main__":
    main()
