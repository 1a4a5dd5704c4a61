import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.operators import profile


@pytest.fixture()
def nums(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(50, 10, 400).round(2),
                        "b": rng.integers(0, 9, 400).astype(float),
                        "h": rng.choice(["p", "q"], 400)})
    pdf.loc[::17, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn(
        "a", F.when(F.isnan("a"), None).otherwise(F.col("a")))


def test_describe_matches_pandas(nums):
    pdf, df = nums
    got = {r.statistic: r for r in profile.describe(df, ["a", "b"]).collect()}
    want = pdf[["a", "b"]].describe()
    for stat in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]:
        for c in ["a", "b"]:
            assert got[stat][c] == pytest.approx(want.loc[stat, c], rel=1e-9)


def test_histogram_matches_numpy(nums):
    pdf, df = nums
    got = sorted(profile.histogram(df, "a", 20).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(pdf["a"].dropna(), bins=20)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_lo for r in got] == pytest.approx(edges[:-1].round(6).tolist())


def test_histogram_hue_has_empty_cells(nums):
    pdf, df = nums
    out = profile.histogram(df, "b", 5, hue="h").collect()
    assert len(out) == 10 and sum(r["count"] for r in out) == len(pdf)


def test_corr_matrix_pairwise(nums):
    pdf, df = nums
    got = {(r.col_a, r.col_b): r.r for r in profile.corr_matrix(df, ["a", "b"]).collect()}
    want = pdf[["a", "b"]].corr()
    assert got[("a", "b")] == pytest.approx(want.loc["a", "b"], abs=1e-6)
    assert got[("b", "a")] == got[("a", "b")]
    assert got[("a", "a")] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        profile.corr_matrix(df.select("h"))


def test_value_counts_and_modes(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("x",), ("z",), (None,)], "c string")
    vc = [(r.c, r["count"]) for r in profile.value_counts(df, "c").collect()]
    assert vc == [("x", 2), ("y", 2), ("z", 1)]
    m = profile.modes(df, ["c"]).collect()[0]
    assert m["mode"] == "x"  # tie -> smallest


def test_agg_list_and_dict(nums):
    pdf, df = nums
    rows = {r.aggregate: r for r in profile.agg_list(df, ["min", "max", "median"],
                                                     ["a", "b"]).collect()}
    assert rows["median"]["a"] == pytest.approx(pdf["a"].median())
    d = {r.aggregate: r for r in profile.agg_dict(df, {"a": "mean", "b": ["sum"]}).collect()}
    assert d["mean"]["a"] == pytest.approx(pdf["a"].mean()) and d["mean"]["b"] is None
    assert d["sum"]["b"] == pytest.approx(pdf["b"].sum())


def test_agg_callable_decomposable(nums):
    pdf, df = nums
    out = profile.agg_callable(df.repartition(5), profile.np_max, ["a", "b"],
                               decomposable=True).collect()[0]
    assert out["a"] == pytest.approx(pdf["a"].max()) and out["b"] == pdf["b"].max()


def test_count_by_nan_category(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "c string")
    got = {r.category: r["count"] for r in profile.count_by(df, "c").collect()}
    assert got == {"a": 2, "nan": 1}
    ordered = profile.count_by(df, "c", order=["a"]).collect()
    assert [(r.category, r.position) for r in ordered] == [("a", 1)]


def test_kde_matches_direct_formula(nums):
    pdf, df = nums
    out = sorted(profile.kde(df.repartition(3), "a", grid_size=50).collect(),
                 key=lambda r: r.point)
    x = pdf["a"].dropna().to_numpy()
    h = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 50)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (
        len(x) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in out] == pytest.approx(grid.round(6).tolist())
    assert [r.density for r in out] == pytest.approx(dens.tolist(), abs=1e-11)
    # a density integrates to ~1 over the extended grid
    assert np.trapezoid(dens, grid) == pytest.approx(1.0, abs=1e-3)


def test_agg_callable_needs_a_way_to_combine(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.1), (5.0, 3.3), (None, None)],
                               "A double, C double").repartition(3)
    with pytest.raises(TypeError):
        profile.agg_callable(df, lambda s: s.max() - s.min(), ["A", "C"])
    got = profile.agg_callable(df, profile.value_range(), ["A", "C"]).first()
    assert got.A == 4.0 and got.C == pytest.approx(2.2)
    count = profile.Aggregator(lambda: 0, lambda n, v: n + len(v), lambda a, b: a + b, float)
    big = spark.range(1000).selectExpr("cast(id as double) AS x")
    assert profile.agg_callable(big.repartition(7), count, "x").first().x == 1000.0

    def moments(state, v):
        return state[0] + len(v), state[1] + v.sum(), state[2] + (v * v).sum()

    std = profile.Aggregator(
        lambda: (0, 0.0, 0.0), moments, lambda a, b: tuple(x + y for x, y in zip(a, b)),
        lambda s: ((s[2] - s[1] ** 2 / s[0]) / (s[0] - 1)) ** 0.5)
    assert profile.agg_callable(big.repartition(7), std, "x").first().x == pytest.approx(
        np.arange(1000).std(ddof=1))
    none = profile.agg_callable(big.limit(0), profile.value_range(), "x").first().x
    assert none is None or np.isnan(none)


def test_numeric_mode_ties_compare_as_numbers(spark):
    df = spark.createDataFrame([(10, "10"), (9, "9"), (10, "10"), (9, "9"), (7, "x")], "n int, t string")
    got = {r.column: r.mode for r in profile.modes(df, ["n", "t"]).collect()}
    assert got == {"n": "9", "t": "10"}


def test_histogram_keeps_null_hue_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (3.0, None), (None, "z")], "x double, h string")
    out = profile.histogram(df, "x", 2, hue="h").collect()
    assert sum(r["count"] for r in out) == 3
    assert {r.hue for r in out} == {"a", None, "z"} and len(out) == 6
    edged = profile.histogram(df, "x", hue="h", edges=[0, 2.5]).collect()
    assert sum(r["count"] for r in edged) == 2 and {r.hue for r in edged} == {"a", None, "z"}


def test_aggregate_contract(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    with pytest.raises(ValueError):
        profile.agg_named(df, "mean", "b")
    with pytest.raises(ValueError):
        profile.agg_list(df, ["nope"], ["a"])
    with pytest.raises(KeyError):
        profile.agg_named(df, "mean", "missing")
    assert profile.agg_dict(df, {"b": "nunique", "a": "max"}).count() == 2
