import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import clean, decision, ml
from retentio.sources import files


def test_head_falls_back_to_five(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert [r.k for r in clean.head(df, 3, "k").collect()] == [0, 1, 2]
    assert clean.head(df, -1, "k").count() == 5
    assert clean.head(df, "x", "k").count() == 5


def test_abc_readout_matches_manual(spark):
    rows = [(i, g, int(i % d == 0)) for i, (g, d) in enumerate(
        [("A (Control)", 2)] * 200 + [("B (Price Offer)", 3)] * 150 + [("C (Service Offer)", 5)] * 100)]
    df = spark.createDataFrame(rows, "customer_id long, group string, churn_value int")
    out = {r.group: r for r in decision.abc_readout(df).collect()}
    ctl = df.filter("group = 'A (Control)'").toPandas()
    c_rate = ctl.churn_value.mean()
    b = df.filter("group = 'B (Price Offer)'").toPandas()
    b_rate = b.churn_value.mean()
    pooled = (ctl.churn_value.sum() + b.churn_value.sum()) / (len(ctl) + len(b))
    se = math.sqrt(pooled * (1 - pooled) * (1 / len(b) + 1 / len(ctl)))
    assert out["B (Price Offer)"].uplift == pytest.approx(round(c_rate - b_rate, 6))
    assert out["B (Price Offer)"].z == pytest.approx(round((c_rate - b_rate) / se, 6))
    assert out["A (Control)"].z is None


def test_scored_sink_is_partitioned_by_flag(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 10, int(i >= 5)) for i in range(10)],
                               "customer_id long, churn_probability double, "
                               "intervention_flag int")
    path = str(tmp_path / "scored")
    files.write_scored(df, path)
    assert sorted(p.name for p in tmp_path.joinpath("scored").iterdir()
                  if p.name.startswith("intervention_flag=")) == [
        "intervention_flag=0", "intervention_flag=1"]
    flagged = files.read_scored(spark, path, flagged_only=True)
    assert sorted(r.customer_id for r in flagged.collect()) == [5, 6, 7, 8, 9]
    assert "PartitionFilters: [isnotnull(intervention_flag" in \
        flagged._jdf.queryExecution().executedPlan().toString()


def test_deploy_loads_instead_of_retraining(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(a > 0.5)) for a in rng.uniform(0, 1, 60)],
                               "x double, label double")
    roles = ml.FeatureRoles(scale=["x"])
    pipe = ml.model_pipelines(roles, names=["LogisticRegression"])["LogisticRegression"]
    path = str(tmp_path / "model")
    m1 = ml.deploy(pipe, df, path)
    other = df.withColumn("label", 1.0 - F.col("label"))  # would train a different model
    m2 = ml.deploy(pipe, other, path)  # loads the saved one
    a = [r.proba for r in ml.with_probability(m1.transform(df)).collect()]
    b = [r.proba for r in ml.with_probability(m2.transform(df)).collect()]
    assert a == pytest.approx(b)
    m3 = ml.deploy(pipe, other, path, overwrite=True)
    c = [r.proba for r in ml.with_probability(m3.transform(df)).collect()]
    assert c != pytest.approx(a)
