import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.operators import clean


@pytest.fixture()
def basic(spark):
    rows = [(1.0, "x", 1.1, dt.datetime(2021, 1, 1)), (2.0, "y", 2.2, dt.datetime(2021, 2, 1)),
            (None, "z", None, dt.datetime(2021, 3, 1)), (4.0, "x", 3.3, dt.datetime(2021, 4, 1)),
            (5.0, "y", float("nan"), dt.datetime(2021, 5, 1))]
    df = spark.createDataFrame(rows, "A double, B string, C double, D timestamp")
    return df.withColumn("id", F.monotonically_increasing_id())


def test_null_counts_and_mask(basic):
    counts = {r["column"]: r["null_count"] for r in clean.null_counts(basic).collect()}
    assert counts == {"A": 1, "B": 0, "C": 2, "D": 0, "id": 0}
    mask = clean.null_mask(basic, "A", "C").collect()
    assert [(r.A, r.C) for r in mask] == [(False, False), (False, False), (True, True),
                                          (False, False), (False, True)]


def test_replace_values_single_and_list(basic):
    out = clean.replace_values(basic, "B", "x", "w").select("B").collect()
    assert [r.B for r in out] == ["w", "y", "z", "w", "y"]
    out = clean.replace_values(basic, "B", ["x", "y"], "q").select("B").collect()
    assert [r.B for r in out] == ["q", "q", "z", "q", "q"]
    with pytest.raises(KeyError):
        clean.replace_values(basic, "nope", "x", "w")


def test_filter_project_and_drop(basic):
    out = clean.filter_project(basic, F.col("A") > 1, "B").collect()
    assert [r.B for r in out] == ["y", "x", "y"]
    assert clean.drop_columns(basic, ["C", "missing"]).columns == ["A", "B", "D", "id"]


def test_drop_rows_by_key(basic, spark):
    keys = spark.createDataFrame([(0,), (2,), (999,)], "k long")
    ids = [r.id for r in basic.select("id").collect()]
    keys = spark.createDataFrame([(ids[0],), (ids[2],), (999,)], "k long")
    out = clean.drop_rows_by_key(basic, keys, "id").collect()
    assert sorted(r.id for r in out) == sorted([ids[1], ids[3], ids[4]])


def test_cleaning_fixture(spark):
    df = spark.createDataFrame(
        [("20", 10, 2), ("nan", 15, 3), ("40", 20, 2)],
        "total_charges_raw string, monthly_charges int, tenure_months int")
    out = clean.fill_total_charges(clean.parse_total_charges(df)).collect()
    assert [r.total_charges for r in out] == [20.0, 45.0, 40.0]


def test_cleaning_blank_and_spaces(spark):
    df = spark.createDataFrame([("100", 50.0, 2), ("", 70.0, 3), (" 12.5 ", 1.0, 1)],
                               "total_charges_raw string, monthly_charges double, "
                               "tenure_months int")
    out = clean.fill_total_charges(clean.parse_total_charges(df)).collect()
    assert [r.total_charges for r in out] == [100.0, 210.0, 12.5]


def test_topk_other_ties_and_null(spark):
    rows = [("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [(None,)]
    df = spark.createDataFrame(rows, "city string")
    out = [r.city for r in clean.topk_other(df, "city", 2).collect()]
    assert sorted(out) == sorted(["a"] * 3 + ["b"] * 2 + ["Other"] * 3)
    kept = [r.city for r in clean.topk_isin(df, "city", 2).collect()]
    assert sorted(kept) == ["a", "a", "a", "b", "b"]
