from retentio.operators import binning


def test_right_closed_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 12.0, 12.5, 30.0, 51.0, -1.0, None)],
                               "t double")
    out = binning.bin_column(df, "t", "g", [0, 12, 30, 50, 60], ["a", "b", "c", "d"])
    assert [r.g for r in out.collect()] == ["a", "a", "b", "b", "d", None, None]


def test_given_edges_counts(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, None, 4.0, 5.0)], "A double")
    out = binning.bin_column(df, "A", "b", [0, 2.5, 5], ["lo", "hi"]).groupBy("b").count()
    got = {r.b: r["count"] for r in out.collect()}
    assert got == {"lo": 2, "hi": 2, None: 1}


def test_equal_width_matches_pandas_rule(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r.k for r in binning.bin_column(df, "x", "k", 3).collect()]
    # pandas.cut(vals, 3): edges (0.991, 4.0], (4.0, 7.0], (7.0, 10.0]
    assert out == [1, 1, 1, 1, 3]


def test_tenure_groups_open_top(spark):
    df = spark.createDataFrame([(t,) for t in (0, 12, 13, 30, 31, 50, 51, 200)],
                               "tenure_months int")
    out = [r.tenure_group for r in binning.bin_tenure(df).collect()]
    assert out == [binning.TENURE_LABELS[i] for i in (0, 0, 1, 1, 2, 2, 3, 3)]


def test_tenure_open_coerces_text(spark):
    df = spark.createDataFrame([(" 5",), ("x",), ("60",)], "tenure_months string")
    out = [r.tenure_group for r in binning.bin_tenure_open(df).collect()]
    assert out == ["New Customer", None, "Veteran Customer"]


def test_tenure_open_keeps_fractions_and_rejects_nan(spark):
    df = spark.createDataFrame([("12.5",), ("-0.5",), ("nan",), ("12",), ("",)], "tenure_months string")
    out = [r.tenure_group for r in binning.bin_tenure_open(df).collect()]
    assert out == [binning.TENURE_LABELS[1], None, None, binning.TENURE_LABELS[0], None]
