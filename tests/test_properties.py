"""Property tests for the float-edge logic behind exact results."""
import bisect

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentio.functions.columns import right_closed_bin_index
from retentio.operators import decision

GRID = [i / 1000.0 for i in range(50, 951)]
# scores near and on grid values, plus arbitrary doubles in [0, 1]
scores = st.one_of(
    st.floats(0.0, 1.0, allow_nan=False),
    st.integers(40, 960).map(lambda i: i / 1000.0),
    st.tuples(st.integers(40, 960), st.sampled_from([-1, 1])).map(
        lambda t: float(np.nextafter(t[0] / 1000.0, t[1] * 2.0))),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(scores, min_size=1, max_size=60))
def test_grid_rank_counts_thresholds_strictly_below(spark, ps):
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.k for r in df.select(decision.grid_rank(F.col("p")).alias("k")).collect()]
    want = [bisect.bisect_left(GRID, p) for p in ps]  # number of grid values < p
    assert got == want


edges_st = st.lists(st.integers(-50, 50), min_size=2, max_size=6, unique=True).map(sorted)


@settings(max_examples=25, deadline=None)
@given(edges_st, st.lists(st.integers(-60, 60), min_size=1, max_size=40))
def test_right_closed_bins_match_interval_rule(spark, edges, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.b for r in df.select(right_closed_bin_index("v", edges).alias("b")).collect()]
    want = []
    for v in values:
        b = None
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            if (lo <= v <= hi) if i == 0 else (lo < v <= hi):
                b = i + 1
                break
        want.append(b)
    assert got == want
