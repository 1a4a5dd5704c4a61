import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest

from retentio.functions import stats
from retentio.operators import chisq


def test_chi2_sf_closed_forms():
    for x in (0.1, 1.0, 3.7, 12.0, 40.0):
        assert stats.chi2_sf_scalar(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert stats.chi2_sf_scalar(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)),
                                                           rel=1e-9)
    assert stats.chi2_ppf_scalar(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-9)
    assert stats.chi2_ppf_scalar(0.95, 4) == pytest.approx(9.487729036781154, rel=1e-9)


def test_noncentral_power_limits():
    crit = stats.chi2_ppf_scalar(0.95, 3)
    assert stats.ncx2_sf_scalar(crit, 3, 0.0) == pytest.approx(0.05, rel=1e-6)
    assert stats.chi2_power_scalar(3, 50.0) > 0.99
    # known value: power of a 1-dof test with noncentrality 7.849 is ~0.80
    assert stats.chi2_power_scalar(1, 7.849) == pytest.approx(0.80, abs=2e-3)


def test_verdict_rules():
    assert chisq.chi2_verdict(0.0003, 0.30, 0.9) == (chisq.REJECT, "Moderate Association",
                                                    pytest.approx(0.1))
    assert chisq.chi2_verdict(0.50, 0.30, 0.9)[0] == chisq.FAIL_TO_REJECT
    assert chisq.chi2_verdict(0.001, 0.85, 1.0)[1] == "Very Strong Association"
    assert not chisq.assumption_met([1, 8, 1, 1])
    assert chisq.assumption_met([10, 8, 11, 12])


@pytest.fixture()
def chi_df(spark):
    rng = np.random.default_rng(42)
    rows = [(int(1 + i % 5), "xy"[i % 2], "PQPQR"[i % 5], str(rng.choice(["Yes", "No"],
                                                                          p=[.7, .3])))
            for i in range(300)]
    return spark.createDataFrame(rows, "A int, B string, C string, D string")


def test_contingency_has_zero_cells(spark):
    rows = [("P", "x")] * 4 + [("P", "y")] * 3 + [("R", "x")] * 2 + [("Q", None)]
    df = spark.createDataFrame(rows, "C string, B string")
    t = {(r.C, r.B): r.observed for r in chisq.contingency(df, "C", "B").collect()}
    assert t == {("P", "x"): 4, ("P", "y"): 3, ("R", "x"): 2, ("R", "y"): 0}


def test_statistic_matches_spark_chisquaretest_without_yates(chi_df, spark):
    ours = {r.feature: r for r in chisq.chi2_tests(chi_df, ["A", "C"], "D", yates=False)
            .collect()}
    # cross-check p with pyspark.ml.stat.ChiSquareTest (Pearson, no Yates)
    pdf = chi_df.toPandas()
    for feat in ["A", "C"]:
        codes = {v: i for i, v in enumerate(sorted(pdf[feat].astype(str).unique()))}
        lab = {v: i for i, v in enumerate(sorted(pdf["D"].unique()))}
        data = [(float(lab[d]), Vectors.dense([float(codes[str(f)])]))
                for f, d in zip(pdf[feat], pdf["D"])]
        r = ChiSquareTest.test(spark.createDataFrame(data, ["label", "features"]),
                               "features", "label").first()
        assert ours[feat].statistic == pytest.approx(r.statistics[0], rel=1e-9)
        assert ours[feat].dof == r.degreesOfFreedom[0]
        assert ours[feat].p_value == pytest.approx(r.pValues[0], rel=1e-6, abs=1e-12)


def test_yates_applies_only_at_one_dof(spark):
    rows = [("a", "y")] * 30 + [("a", "n")] * 10 + [("b", "y")] * 15 + [("b", "n")] * 25
    df = spark.createDataFrame(rows, "f string, l string")
    with_y = chisq.chi2_statistics(df, ["f"], "l", yates=True).first().statistic
    no_y = chisq.chi2_statistics(df, ["f"], "l", yates=False).first().statistic
    obs = np.array([[30, 10], [15, 25]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + 0.5 * np.sign(exp - obs)
    assert no_y == pytest.approx(((obs - exp) ** 2 / exp).sum())
    assert with_y == pytest.approx(((adj - exp) ** 2 / exp).sum())


def test_assumption_stop(spark):
    rows = [("a", "y")] * 2 + [("b", "n")] * 1 + [("c", "y")] * 1 + [("a", "n")]
    t = chisq.chi2_tests(spark.createDataFrame(rows, "f string, l string"), ["f"], "l").first()
    assert not t.assumption_met and t.verdict == chisq.NOT_MET and t.p_value is None


def test_many_categories_finish(spark):
    """200,000 categories against two labels: no window, no collected set."""
    df = spark.range(400_000).selectExpr("concat('v', id % 200000) AS f", "id % 3 = 0 AS y")
    got = chisq.chi2_statistics(df, ["f"], "y").first()
    assert (got.n, got.n_rows, got.n_cols, got.cells) == (400_000, 200_000, 2, 400_000)
