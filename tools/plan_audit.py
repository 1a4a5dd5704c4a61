"""Executed-plan audit of every lazy registered query -> PLANS.md.

For each query: shuffles (hash/range/single-partition exchanges), scans of
the large ``orders``/``lineitem`` tables, join strategies, windows and Python
evaluation nodes, read from the final adaptive plan after execution.
Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
sys.path.insert(0, __file__.rsplit("/tools/", 1)[0] + "/tests")

from retentio.plans.registry import QUERIES  # noqa: E402
from retentio.session import get_session  # noqa: E402
from test_entry import EAGER  # noqa: E402

PATTERNS = {
    "BHJ": r"BroadcastHashJoin", "SMJ": r"SortMergeJoin", "SHJ": r"ShuffledHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin", "Cartesian": r"CartesianProduct",
    "Window": r"\bWindow\b", "Python": r"ArrowEvalPython|FlatMapCoGroupsInPandas|"
                                     r"MapInPandas|AggregateInPandas|ArrowAggregatePython",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[4]", 8)
    lines = ["# Plan audit", "",
             f"Final adaptive plans after execution at `{sf}` (`tools/plan_audit.py`).",
             "Shuffles = hash/range/single-partition exchanges (incl. subqueries); "
             "scans = reads of `orders`/`lineitem`.", "",
             "| query | shuffles | orders scans | lineitem scans | "
             + " | ".join(PATTERNS) + " |",
             "| --- | ---: | ---: | ---: | " + " | ".join("---:" for _ in PATTERNS) + " |"]
    for name, q in QUERIES.items():
        if name in EAGER:
            continue
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        p = df._jdf.queryExecution().executedPlan().toString()
        final = "\n".join(x for x in p.split("\n") if "Initial Plan" not in x)
        final = re.sub(r"== Initial Plan ==.*?(?=== Final Plan ==|\Z)", "", p, flags=re.S)
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)",
                            final))
        cells = [str(len(re.findall(pat, final))) for pat in PATTERNS.values()]
        lines.append(f"| {name} | {ex} | {final.count('orders.parquet')} | "
                     f"{final.count('lineitem.parquet')} | " + " | ".join(cells) + " |")
    open(__file__.rsplit("/tools/", 1)[0] + "/PLANS.md", "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
