"""Same results after repartition(7): keyed hashes, no order dependence."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import chisq, decision, ensemble, impute, ml, profile


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(21)
    n = 1500
    rows = [(int(i), str(rng.choice(["a", "b", "c"])), str(rng.choice(["x", "y"])),
             int(rng.integers(0, 2)), float(np.round(rng.uniform(0, 1), 3)),
             float(np.round(rng.uniform(10, 100), 2)) if i % 9 else None,
             int(rng.integers(0, 60)))
            for i in range(n)]
    return spark.createDataFrame(
        rows, "customer_id long, city string, contract string, churn_value int, "
              "churn_probability double, monthly_charges double, tenure_months int")


def collect(df, *order):
    rows = df.orderBy(*order).collect() if order else df.collect()
    # floating sums depend on partition order in the last bits only
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("op", ["chi2", "profit", "auc", "folds", "value_counts", "impute",
                                "vote", "assign", "describe"])
def test_same_result_after_repartition(frame, op):
    def run(df):
        if op == "chi2":
            return collect(chisq.chi2_statistics(df, ["city", "contract"], "churn_value"),
                           "feature")
        if op == "profit":
            return collect(decision.profit_curve(df, 500.0, 10, 0.5), "threshold")
        if op == "auc":
            return collect(decision.roc_auc(df))
        if op == "folds":
            return collect(ml.stratified_folds(df, "churn_value").select("customer_id", "fold"),
                           "customer_id")
        if op == "value_counts":
            return collect(profile.value_counts_many(df, ["city", "contract"]), "column", "value")
        if op == "impute":
            ref = df.withColumn("total_charges", F.lit(1.0))
            out = impute.impute_conditional(
                ref.withColumn("internet_service", F.col("contract")), ref.withColumn(
                    "internet_service", F.col("contract")), categorical=("city", "contract"),
                dependencies={}, median_parent="internet_service")
            return collect(out, "customer_id")
        if op == "vote":
            long = df.select("customer_id", F.col("churn_value").alias("label"),
                             F.col("churn_probability").alias("m1"),
                             (1 - F.col("churn_probability")).alias("m2")).unpivot(
                ["customer_id", "label"], ["m1", "m2"], "model", "proba")
            return collect(ensemble.soft_vote(long, ["m1", "m2"]), "weights")
        if op == "assign":
            s = decision.score(df.withColumn("contract", F.lit("Month-to-month")), 0.5)
            return collect(decision.abc_assign(s).select("customer_id", "group"), "customer_id")
        if op == "describe":
            return collect(profile.describe(df, ["monthly_charges", "tenure_months"]),
                           "statistic")
    a = run(frame)
    b = run(frame.repartition(7))
    assert a == b
