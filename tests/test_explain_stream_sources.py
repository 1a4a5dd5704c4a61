import os
import tempfile
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.operators import explain, ml
from retentio.sources import files, synthetic
from retentio.streaming import score_stream

FEATS = ["num_a", "num_b", "cat_c"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(123)
    n = 300
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 10, n)
    pdf = pd.DataFrame({"customer_id": np.arange(n), "num_a": a, "num_b": b,
                        "cat_c": rng.choice(["u", "v", "w"], n),
                        "label": ((5 * a + 0.5 * b + rng.normal(0, 1, n)) > 4).astype(float)})
    df = spark.createDataFrame(pdf)
    roles = ml.FeatureRoles(one_hot=["cat_c"], scale=["num_a", "num_b"])
    pipe = ml.model_pipelines(roles, names=["LogisticRegression"])["LogisticRegression"]
    return df, pipe.fit(df), roles


def test_sampled_shapley_additivity(spark, fitted):
    df, model, _ = fitted
    bg = explain.background_sample(model, df, FEATS, fraction=0.5, k=3)
    assert bg.count() == 3 and abs(sum(r.weight for r in bg.collect()) - 1) < 1e-9
    rows = df.filter("customer_id < 40")
    phi = explain.sampled_shapley(model, rows, bg, FEATS, samples=8)
    # per draw, contributions add up to f(x) - f(z): check against the mean over draws
    got = phi.groupBy("customer_id").agg(F.sum("phi").alias("s"), F.first("f_x").alias("fx"))
    fz = {r.bg_id: r.p for r in explain._proba(model.transform(bg)).select(
        "bg_id", F.col("_f").alias("p")).collect()}
    assert got.count() == 40 and phi.select("feature").distinct().count() == 3
    for r in got.collect():
        assert min(fz.values()) - 1e-9 <= r.fx - r.s <= max(fz.values()) + 1e-9


def test_shapley_partition_independent(spark, fitted):
    df, model, _ = fitted
    bg = explain.background_sample(model, df, FEATS, fraction=0.5, k=3)
    rows = df.filter("customer_id < 20")
    a = {(r.customer_id, r.feature): r.phi for r in
         explain.sampled_shapley(model, rows, bg, FEATS, samples=4).collect()}
    b = {(r.customer_id, r.feature): r.phi for r in
         explain.sampled_shapley(model, rows.repartition(5), bg, FEATS, samples=4).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_linear_explanation_adds_to_margin(spark, fitted):
    df, model, roles = fitted
    ranked, base = explain.explain_linear(model, df, df, ml.slot_names(model, roles),
                                          top=100)
    b = base.first().base_value
    lr = model.stages[-1]
    margins = {r.customer_id: float(r.m) for r in model.transform(df).select(
        "customer_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    sums = {r.customer_id: r.s for r in ranked.groupBy("customer_id").agg(
        F.sum("phi").alias("s")).collect()}
    assert lr is not None
    for k, s in list(sums.items())[:50]:
        assert s == pytest.approx(margins[k] - b, abs=1e-9)


def test_synthetic_rules(spark):
    keys = spark.range(2000).withColumnRenamed("id", "k")
    df = synthetic.generate_customers(keys, "k", seed=123)
    assert df.columns == list(synthetic.COLUMNS) and len(df.columns) == 28
    pdf = df.toPandas()
    again = synthetic.generate_customers(keys.repartition(3), "k", seed=123).toPandas()
    pd.testing.assert_frame_equal(pdf.sort_values("customer_id").reset_index(drop=True),
                                  again.sort_values("customer_id").reset_index(drop=True))
    assert pdf.customer_id.iloc[0].endswith("-CUSTM") and "0001-CUSTM" in set(pdf.customer_id)
    assert pdf.tenure_months.between(1, 72).all()
    assert (pdf.loc[pdf.internet_service == "No", "online_security"]
            == "No internet service").all()
    assert (pdf.loc[pdf.phone_service == "No", "multiple_lines"] == "No phone service").all()
    fiber = pdf.internet_service == "Fiber optic"
    assert (pdf.loc[fiber, "monthly_charges"] >= 50).all()
    assert (pdf.loc[~fiber, "monthly_charges"] >= 18).all()
    one = pdf.tenure_months <= 1
    assert (pdf.loc[one, "total_charges"] == pdf.loc[one, "monthly_charges"]).all()
    assert 0.5 < (pdf.contract == "Month-to-month").mean() < 0.6
    assert pdf.latitude.between(32.5, 42).all() and pdf.zip_code.astype(int).between(
        90001, 96162).all()


def test_file_source_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_customers(spark, str(tmp_path / "nope.parquet"))
    p = str(tmp_path / "t.csv")
    pd.DataFrame({"A": [1, 2], "B": [3, 4], "C": ["2021-01-01", "2021-02-01"]}).to_csv(
        p, index=False)
    df = files.read_customers(spark, p, "A int, B int, C string", fmt="csv", date_cols=["C"])
    assert dict(df.dtypes)["C"] == "timestamp" and df.count() == 2
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "A int").write.parquet(empty)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        files.read_customers(spark, empty)
        assert any("no rows" in str(x.message) for x in w)


def test_stream_scorer_end_to_end(spark, tmp_path):
    ref = spark.createDataFrame(
        [(i, "NY" if i % 3 else "LA", "Month-to-month" if i % 2 else "Two year",
          "DSL" if i % 4 else "Fiber", "check", 5 + i % 40, 20.0 + i % 30, 100.0 + i,
          float(i % 2)) for i in range(200)],
        "customer_id bigint, city string, contract string, internet_service string, "
        "payment_method string, tenure_months int, monthly_charges double, "
        "total_charges double, label double")
    from retentio.operators import binning
    train = ml.fill_categoricals(binning.bin_tenure(ref), ["city", "contract",
                                                          "internet_service",
                                                          "payment_method", "tenure_group"])
    roles = ml.FeatureRoles(one_hot=["city", "contract", "internet_service", "payment_method",
                                     "tenure_group"], scale=["monthly_charges"])
    model = ml.model_pipelines(roles, names=["LogisticRegression"])[
        "LogisticRegression"].fit(train)
    src = str(tmp_path / "in")
    inc = ref.drop("label").withColumn(
        "monthly_charges", F.when(F.col("customer_id") % 5 == 0, None)
        .otherwise(F.col("monthly_charges")))
    inc.repartition(3).write.parquet(src)
    schema = inc.schema
    q = score_stream.start_stream(spark, src, schema, ref, model, str(tmp_path / "out"),
                                  str(tmp_path / "ck"), max_files_per_trigger=1)
    q.awaitTermination()
    out = score_stream.read_sink(spark, str(tmp_path / "out"))
    assert out.count() == 200
    assert out.filter(F.col("monthly_charges").isNull()).count() == 0
    assert out.select("batch_id").distinct().count() >= 2
    assert set(out.columns) >= {"churn_probability", "intervention_flag", "tenure_group"}
