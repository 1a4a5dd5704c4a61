import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import profile
from retentio.operators.quantiles import exact_quantiles, medians, prefix_sums, quantile_table, quantile_values

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("partitions", [1, 4])
def test_exact_quantiles_match_numpy(spark, partitions):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 700), np.full(200, 0.25), rng.integers(0, 5, 100)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(partitions)
    assert exact_quantiles(df, "x", PROBS) == pytest.approx(
        np.percentile(x, [p * 100 for p in PROBS]), abs=1e-12)


def test_exact_quantiles_edge_cases(spark):
    one = spark.createDataFrame([(3.0,), (None,), (float("nan"),)], "x double")
    assert exact_quantiles(one, "x", [0.5]) == [3.0]
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, "x", [0.5]) == [None]


def test_wide_range_and_infinity(spark):
    wide = [2.0 ** e for e in range(-1000, 1001)]
    df = spark.createDataFrame([(v,) for v in wide], "x double")
    assert exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0]) == [wide[0], wide[500], 1.0, wide[-1]]
    inf = spark.range(999).select(F.col("id").cast("double").alias("x")).union(
        spark.createDataFrame([(math.inf,)], "x double"))
    assert exact_quantiles(inf, "x", [0.5, 1.0]) == [499.5, math.inf]
    assert exact_quantiles(spark.createDataFrame([(math.inf,), (math.inf,)], "x double"),
                           "x", [0.5]) == [math.inf]


def test_grouped_quantiles_with_null_groups(spark):
    rows = [(g, float(v)) for g, n in (("a", 5), (None, 4), ("b", 1)) for v in range(n)]
    df = spark.createDataFrame([*rows, ("c", None)], "g string, x double")
    got = {r.g: r["quantile"] for r in quantile_table(df, ["x"], [0.5], by=["g"]).collect()}
    assert got == {"a": 2.0, None: 1.5, "b": 0.0}
    assert medians(df, ["x"]) == {"x": float(np.median([v for _, v in rows]))}


def test_prefix_sums(spark):
    df = spark.createDataFrame([(None, 3, 5), (None, 1, 2), ("k", 2, 7)], "g string, o int, n long")
    got = {(r.g, r.o): (r.before, r.total) for r in prefix_sums(df, ["g"], "o", "n").collect()}
    assert got == {(None, 1): (0, 7), (None, 3): (2, 7), ("k", 2): (0, 7)}


def test_describe_matches_pandas_and_plans_no_percentile(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(5, 2, 500), rng.integers(0, 9, 500).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    out = profile.describe(df)
    got = {r.statistic: r for r in out.collect()}
    for c, x in (("a", a), ("b", b)):
        for s, p in (("25%", 25), ("50%", 50), ("75%", 75)):
            assert got[s][c] == pytest.approx(np.percentile(x, p), rel=1e-12)
        assert got["std"][c] == pytest.approx(x.std(ddof=1))
    for frame in (out, profile.agg_list(df, ["median", "max"]), profile.agg_named(df, "median")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan


@pytest.mark.parametrize("limit", [20, 200])
def test_brackets_are_narrowed_until_they_are_small(spark, limit):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), [np.inf] * 40, [-np.inf] * 3])
    b = rng.integers(0, 4, len(a)).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if i % 11 else None, float("nan")) for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double, c double").repartition(5)
    got = quantile_values(df, ["a", "b", "c"], PROBS, limit=limit)
    y = np.array([v for i, v in enumerate(b) if i % 11])
    for p in PROBS:
        assert got["b", p] == pytest.approx(np.percentile(y, 100 * p)) and got["c", p] is None
        pos = (len(a) - 1) * p
        lo, hi = np.sort(a)[int(np.floor(pos))], np.sort(a)[int(np.ceil(pos))]
        assert got["a", p] == (lo if lo == hi or pos == int(pos) else pytest.approx(lo + (pos - int(pos)) * (hi - lo)))


def test_a_sketch_that_misses_costs_only_a_round(spark, monkeypatch):
    from retentio.operators import quantiles

    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(quantiles, "SLACK", 0.0)  # intervals of one value, which hardly ever hold the rank
    assert quantile_values(df, ["x"], [0.5, 0.9], limit=50) == {("x", 0.5): 2499.5, ("x", 0.9): pytest.approx(4499.1)}


def test_few_distinct_and_roles(spark):
    rows = [(i, f"s{i % 5}", f"t{i % 6}", None, i % 2 == 0, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c string, d string, e boolean, f double").repartition(7)
    assert profile.few_distinct(df, ["a", "b", "c", "d", "e", "f"], 6) == {"a": 6, "b": 5, "c": 6, "d": 0, "e": 2, "f": 6}
    assert profile.few_distinct(df.limit(0), ["a", "b"], 6) == {"a": 0, "b": 0}
    plan = df.mapInArrow(lambda b: b, df.schema)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_correlation_of_many_columns_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 1, (400, 60))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[:, 2] = 3.0
    hole = rng.random(x.shape) < 0.1
    df = spark.createDataFrame([tuple(None if h else float(v) for v, h in zip(r, hs)) for r, hs in zip(x, hole)],
                               ", ".join(f"c{i} double" for i in range(60))).repartition(6)
    got = {(r.col_a, r.col_b): r.r for r in profile.corr_matrix(df).collect()}
    assert len(got) == 3600
    for i, j in [(0, 1), (0, 0), (5, 40), (1, 59), (2, 3), (2, 2)]:
        both = ~hole[:, i] & ~hole[:, j]
        if 2 in (i, j):
            assert got[f"c{i}", f"c{j}"] is None
        else:
            assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-5)
