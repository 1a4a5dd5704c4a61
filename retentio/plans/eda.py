"""EDA report: the data behind every chart as ONE long table.

``(chart, kind, category, hue, bin_lo, bin_hi, value)`` - category counts
(optionally split by churn), equal-width histograms (20 bins, churned-only
variants), counts of the binned columns and the correlation matrix.

Two passes over the frame: one aggregate row with every histogram's range and
every correlation, then one long aggregate - each row becomes an array of
(chart, category, hue, bin) entries and a single partially aggregated
``groupBy`` counts them all.  Empty bins enter as entries of weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile
from ..session import cut_lineage

COUNT_CHARTS = ("city", "contract", "internet_service", "payment_method")
PLAIN_COUNT_CHARTS = ("churn_value", "tenure_group", "churn_score_band", "customer_value")
HIST_CHARTS = ("tenure_months", "monthly_charges", "total_charges", "cltv", "churn_score")
CHURNED_HIST_CHARTS = ("tenure_months", "monthly_charges", "churn_score", "cltv")
CORR_COLS = ("tenure_months", "monthly_charges", "total_charges", "cltv", "churn_score",
             "churn_value")
BINS = 20


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("nan"))


def _entry(chart: str, kind: str, category: Column, hue: Column | None = None) -> Column:
    return F.struct(F.lit(chart).alias("chart"), F.lit(kind).alias("kind"), category.alias("category"),
                    (hue if hue is not None else F.lit(None).cast("string")).alias("hue"))


def _first_pass(src: DataFrame) -> dict:
    """Ranges of every histogram (whole and churned-only) and all correlations: one row."""
    churned = F.col("churn_value") == 1
    exprs = []
    for c, keep, tag in [(c, F.lit(True), "") for c in HIST_CHARTS] + [
            (c, churned, "|churned") for c in CHURNED_HIST_CHARTS]:
        v = F.col(c).cast("double")
        v = F.when(keep & ~F.isnan(v), v)
        exprs += [F.min(v).alias(f"mn_{c}{tag}"), F.max(v).alias(f"mx_{c}{tag}")]
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
            exprs.append(F.round(F.when(~F.isnan(r), r), 6).alias(f"r_{a}_{b}"))
    return src.agg(*exprs).first().asDict()


def eda_report(binned: DataFrame, checkpoint: bool = False) -> DataFrame:
    """The chart table of ``binned``; ``checkpoint=True`` writes ``binned`` first
    (use it when it is an expensive lineage)."""
    src = cut_lineage(binned) if checkpoint else binned
    spark = src.sparkSession
    got = _first_pass(src)
    entries = []
    for c in COUNT_CHARTS:
        entries.append(_entry(f"count:{c}", "count", _text(c)))
        entries.append(_entry(f"count:{c}|churn", "count", _text(c), _text("churn_value")))
    entries += [_entry(f"count:{c}", "count", _text(c)) for c in PLAIN_COUNT_CHARTS]
    edges = []
    for c, tag in [(c, "") for c in HIST_CHARTS] + [(c, "|churned") for c in CHURNED_HIST_CHARTS]:
        v = F.col(c).cast("double")
        lo, hi = profile.bin_range(got[f"mn_{c}{tag}"], got[f"mx_{c}{tag}"])
        known = v.isNotNull() & ~F.isnan(v)
        if tag:
            known = known & (F.col("churn_value") == 1)
        bin_no = profile.equal_width_bin(v, lo, hi, BINS).cast("string")
        entries.append(F.when(known, _entry(f"hist:{c}{tag}", "histogram", bin_no)))
        edges += [(f"hist:{c}{tag}", "histogram", str(i + 1), *profile.bin_edges(lo, hi, BINS, i))
                  for i in range(BINS)]
    grid = spark.createDataFrame(  # charts x bins rows
        edges, "chart string, kind string, category string, bin_lo double, bin_hi double")
    long = (src.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
            .select("e.*", F.lit(1).alias("w"))
            .union(grid.select("chart", "kind", "category", F.lit(None).cast("string"), F.lit(0))))
    counts = long.groupBy("chart", "kind", "category", "hue").agg(F.sum("w").cast("double").alias("value"))
    charts = counts.join(F.broadcast(grid), ["chart", "kind", "category"], "left").select(
        "chart", "kind", "category", "hue", F.round("bin_lo", 6).alias("bin_lo"),
        F.round("bin_hi", 6).alias("bin_hi"), "value")
    pairs = [("corr", "corr", a, b, got.get(f"r_{a}_{b}", got.get(f"r_{b}_{a}")))
             for a in CORR_COLS for b in CORR_COLS]
    corr = spark.createDataFrame(pairs, "chart string, kind string, category string, hue string, value double")
    return charts.unionByName(corr, allowMissingColumns=True)
