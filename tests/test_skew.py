"""A hot key holding a third of all rows must not change results."""
import os
import shutil
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.operators import clean, decision, profile
from retentio.sources.mart import customer_360


@pytest.fixture(scope="module")
def skewed_dir(spark):
    src = "/root/testdata/sf0.001"
    d = tempfile.mkdtemp(prefix="retentio-skew-")
    for t in ("customer", "nation"):
        shutil.copy(f"{src}/{t}.parquet", f"{d}/{t}.parquet")
    orders = pd.read_parquet(f"{src}/orders.parquet")
    hot = orders.sample(frac=0.5, replace=True, random_state=1).copy()
    hot["o_custkey"] = orders["o_custkey"].iloc[0]
    hot["o_orderkey"] = np.arange(len(hot)) + 10_000_000
    skewed = pd.concat([orders, hot], ignore_index=True)
    skewed.to_parquet(f"{d}/orders.parquet", index=False)
    return d, skewed


def test_mart_with_hot_customer(spark, skewed_dir):
    d, orders = skewed_dir
    hot_key = orders["o_custkey"].iloc[0]
    assert (orders.o_custkey == hot_key).mean() > 0.33
    m = {r.customer_id: r for r in customer_360(spark, d).collect()}
    g = orders.groupby("o_custkey")
    spend = g.o_totalprice.sum()
    first, last = g.o_orderdate.min(), g.o_orderdate.max()
    for k in [hot_key] + list(spend.index[:20]):
        if k not in m:
            continue
        r = m[k]
        assert r.tenure_months == (last[k].normalize() - first[k].normalize()).days // 30
        assert float(r.total_charges_raw or "nan") == pytest.approx(round(spend[k], 2)) \
            or r.total_charges_raw == ""


def test_value_counts_and_profit_with_hot_value(spark):
    rows = [("hot", 1, 0.9)] * 3000 + [(f"c{i % 7}", i % 2, (i % 100) / 100) for i in range(6000)]
    df = spark.createDataFrame(rows, "city string, churn_value int, churn_probability double")
    vc = {r.city: r["count"] for r in profile.value_counts(df.repartition(8), "city").collect()}
    assert vc["hot"] == 3000 and sum(vc.values()) == 9000
    top = [r.city for r in clean.topk_isin(df, "city", 1).select("city").distinct().collect()]
    assert top == ["hot"]
    curve = {r.threshold: r for r in decision.profit_curve(df, 100, 10, 0.5).collect()}
    p = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    t = 0.5
    assert curve[t].tp == int(((p > t) & (y == 1)).sum())
    assert curve[t].fp == int(((p > t) & (y == 0)).sum())
