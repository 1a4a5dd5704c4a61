"""Chi-square tests of independence (survey §2.7), as DataFrame jobs.

The expensive part - observed counts - is one ``groupBy(feature, value,
label)`` with map-side partial aggregation, so hot categories are combined
before the shuffle.  Everything after works on the contingency cells, whose
number is bounded by the categories' cardinalities, not by the data.

``chi2_scan`` tests many feature columns against one label in ONE pass:
features are unpivoted to ``(feature, value)`` and all tables are built by
a single aggregation; everything else reads its small result.

Rules (fixed values): expected = row total x column total / n; the test
stops when more than 20% of cells have expected < 5; Yates' continuity
correction (observed moved 0.5 towards expected) is applied when dof = 1
and ``yates`` is on; Cramer's V = sqrt(stat / (n (min(r, c) - 1)));
power at alpha 0.05 with noncentrality n V^2; verdict: p <= alpha rejects,
V <= .10 Weak, <= .30 Moderate, <= .50 Strong, else Very Strong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_power, chi2_pvalue
from ..session import cut_lineage
from .clean import require_columns

# Verdict texts.
REJECT = "Reject Null Hypothesis (H0)"
FAIL_TO_REJECT = "Fail to Reject the Null Hypothesis (H0)"
NOT_MET = "Assumption Not Met"


def _counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, value, label_value, observed)`` of the cells that occur.

    The one pass over the data; written, because totals and cells read it.
    """
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in features],
                      F.col(label).cast("string").alias("label_value"))
            .filter(F.col("label_value").isNotNull())
            .unpivot(["label_value"], list(features), "feature", "value")
            .filter(F.col("value").isNotNull()))
    return cut_lineage(long.groupBy("feature", "value", "label_value").agg(
        F.count(F.lit(1)).alias("observed")))


def expected_cells(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """All cells of each feature's table, zero cells included, with row, column
    and table totals, expected counts and the table's shape.

    Totals are grouped tables joined back on (feature, value), (feature,
    label) and feature; no window and no collected set spans a feature.
    """
    counts = _counts(df, features, label)
    rows = counts.groupBy("feature", "value").agg(F.sum("observed").alias("row_total"))
    cols = counts.groupBy("feature", "label_value").agg(F.sum("observed").alias("col_total"))
    shape = (rows.groupBy("feature").agg(F.sum("row_total").alias("n"),
                                         F.count(F.lit(1)).cast("int").alias("n_rows"))
             .join(cols.groupBy("feature").agg(F.count(F.lit(1)).cast("int").alias("n_cols")),
                   "feature"))
    # rows x columns of one feature are the cells of its table: the result itself
    grid = rows.join(cols, "feature").join(shape, "feature")
    return (grid.join(counts, ["feature", "value", "label_value"], "left")
            .withColumn("observed", F.coalesce(F.col("observed"), F.lit(0)).cast("bigint"))
            .withColumn("expected", F.col("row_total").cast("double") * F.col("col_total")
                        / F.col("n")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed counts of two categoricals, zero cells included:
    ``(a, b, observed)``."""
    require_columns(df, a, b)
    cells = expected_cells(df, [a], b)
    return cells.select(F.col("value").alias(a), F.col("label_value").alias(b), "observed")


def chi2_expected(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, observed, expected)`` for one pair."""
    require_columns(df, a, b)
    e = expected_cells(df, [a], b)
    return e.select(F.col("value").alias(a), F.col("label_value").alias(b), "observed",
                    "expected")


def chi2_statistics(df: DataFrame, features: Sequence[str], label: str,
                    yates: bool = True) -> DataFrame:
    """Per feature: ``n, n_rows, n_cols, dof, cells, cells_lt5, share_lt5,
    assumption_met, statistic, cramers_v`` (one job for all features)."""
    require_columns(df, *features, label)
    e = expected_cells(df, features, label)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    o, ex = F.col("observed").cast("double"), F.col("expected")
    o_adj = (F.when((dof == 1) & F.lit(yates), o + 0.5 * F.signum(ex - o)).otherwise(o))
    e = e.withColumn("dof", dof).withColumn("term", (o_adj - ex) * (o_adj - ex) / ex)
    per = e.groupBy("feature").agg(
        F.first("n").alias("n"), F.first("n_rows").alias("n_rows"),
        F.first("n_cols").alias("n_cols"), F.first("dof").alias("dof"),
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("expected") < 5).alias("cells_lt5"),
        F.sum("term").alias("statistic"))
    share = F.col("cells_lt5") / F.col("cells")
    k = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    return (per.withColumn("share_lt5", share)
            .withColumn("assumption_met", share <= 0.2)
            .withColumn("cramers_v", F.when((k > 0) & (F.col("n") > 0),
                                            F.sqrt(F.col("statistic") / (F.col("n") * k)))))


def _strength(v: Column) -> Column:
    # fixed values: limits and names of the strengths
    return (F.when(v <= 0.10, "Weak Association").when(v <= 0.30, "Moderate Association")
            .when(v <= 0.50, "Strong Association").otherwise("Very Strong Association"))


def chi2_tests(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.05,
               yates: bool = True) -> DataFrame:
    """Statistics plus p-value, power and verdict per feature.

    p and power are computed by pandas UDFs over the per-feature rows only.
    When the expected-count assumption fails the test is stopped: p, power
    and verdict strength are NULL and the verdict says so.
    """
    if not (0 < alpha < 1):
        raise ValueError("'alpha' must be a float between 0 and 1.")
    st = chi2_statistics(df, features, label, yates)
    ok = F.col("assumption_met") & (F.col("dof") > 0)
    nc = F.col("n") * F.col("cramers_v") * F.col("cramers_v")
    out = (st.withColumn("p_value", F.when(ok, chi2_pvalue(F.col("statistic"),
                                                           F.col("dof").cast("double"))))
           .withColumn("power", F.when(ok, chi2_power(F.col("dof").cast("double"), nc,
                                                      F.lit(0.05)))))
    reject = F.col("p_value") <= alpha
    return (out.withColumn("verdict", F.when(~F.col("assumption_met"), NOT_MET)
                           .when(reject, REJECT).otherwise(FAIL_TO_REJECT))
            .withColumn("strength", F.when(F.col("assumption_met") & reject,
                                           _strength(F.col("cramers_v"))))
            .withColumn("type_ii_error", F.when(F.col("assumption_met") & reject,
                                                1 - F.col("power"))))


def chi2_verdict(p_value: float, cramers_v: float, power: float, alpha: float = 0.05
                 ) -> tuple[str, str | None, float | None]:
    """The verdict rules on one row of already computed statistics."""
    if p_value <= alpha:
        if cramers_v <= 0.10:
            s = "Weak Association"
        elif cramers_v <= 0.30:
            s = "Moderate Association"
        elif cramers_v <= 0.50:
            s = "Strong Association"
        else:
            s = "Very Strong Association"
        return REJECT, s, 1 - power
    return FAIL_TO_REJECT, None, None


def assumption_met(expected: Sequence[float]) -> bool:
    """True when at most 20% of cells have expected count < 5."""
    cells = list(expected)
    return (sum(1 for e in cells if e < 5) / len(cells)) * 100 <= 20
