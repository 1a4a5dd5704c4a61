"""Right-closed binning (survey §2.5).

Intervals are ``(lo, hi]``; the first also holds its low edge; values
outside the edges, or NULL, get NULL.  ``ml.feature.Bucketizer`` is
left-closed, so bins are ``CASE WHEN`` chains (codegen'd, no shuffle).
Integer ``bins`` means equal width over the data range, the low edge moved
down by 0.1% of the range (the public pandas rule); min/max come from one
aggregate row fetched once (bounded), then act as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import right_closed_bin, right_closed_bin_index, trim_to_double
from .clean import require_columns

# Edges and labels of the three customer bins.
TENURE_EDGES = (0, 12, 30, 50)
TENURE_LABELS = ("New Customer", "New/Established Customer",
                 "Established/Veteran Customer", "Veteran Customer")
SCORE_EDGES = (0, 25, 50, 75, 100)
SCORE_LABELS = ("Less Probability of Churn", "Less/Moderate Probability of Churn",
                "Moderate/High Probability of Churn", "High Probability of Churn")
VALUE_EDGES = (0, 3000, 4000, 5000)
VALUE_LABELS = ("Low Value", "Low/Mid Value", "Mid/High Value", "High Value")


def _equal_width_index(df: DataFrame, col: str, n: int) -> Column:
    """1..n interval of ``col`` among ``n`` equal-width right-closed bins."""
    # one bounded row fetched once; literals afterwards
    st = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx")
                ).first()
    if st["mn"] is None:
        return F.lit(None).cast("int")
    mn, mx = F.lit(float(st["mn"])), F.lit(float(st["mx"]))
    v = F.col(col).cast("double")
    step = (mx - mn) / F.lit(float(n))
    # ceil estimate, then one flat repair so that edge(k-1) < v <= edge(k)
    k = F.least(F.greatest(F.ceil((v - mn) / step).cast("int"), F.lit(1)), F.lit(n))
    edge = lambda i: F.when(i >= F.lit(n), mx).otherwise(mn + step * i)
    k = (k - F.when((k > 1) & (v <= edge(k - 1)), 1).otherwise(0)
         + F.when((k < n) & (v > edge(k)), 1).otherwise(0))
    in_range = v.between(mn, mx)
    # constant column: pandas widens the range by 0.1% on each side -> bin 1..n/2
    return F.when(mx == mn, F.lit((n + 1) // 2) if n > 1 else F.lit(1)) \
        .when(in_range, k).otherwise(F.lit(None).cast("int"))


def bin_column(df: DataFrame, col: str, new_col: str, bins: int | Sequence[float],
               labels: Sequence[str] | None = None, include_lowest: bool = True,
               open_top: bool = False) -> DataFrame:
    """Add ``new_col`` with the label (or 1-based index) of ``col``'s bin."""
    require_columns(df, col)
    if isinstance(bins, int):
        if bins < 1:
            raise ValueError("bins must be >= 1")
        idx = _equal_width_index(df, col, bins)
        if labels is None:
            return df.withColumn(new_col, idx)
        if len(labels) != bins:
            raise ValueError(f"{len(labels)} labels for {bins} bins")
        m = F.create_map(*[x for i, lab in enumerate(labels)
                           for x in (F.lit(i + 1), F.lit(lab))])
        return df.withColumn(new_col, m[idx])
    if labels is None:
        return df.withColumn(new_col, right_closed_bin_index(col, bins, include_lowest))
    return df.withColumn(new_col, right_closed_bin(col, bins, labels, include_lowest,
                                                   open_top=open_top))


def bin_tenure(df: DataFrame, col: str = "tenure_months", new_col: str = "tenure_group"
               ) -> DataFrame:
    """Tenure groups 0-12-30-50-max; the top group is open (> 50)."""
    return bin_column(df, col, new_col, list(TENURE_EDGES) + [float("inf")],
                      TENURE_LABELS, open_top=True)


def bin_tenure_open(df: DataFrame, col: str = "tenure_months",
                    new_col: str = "tenure_group") -> DataFrame:
    """Tenure groups after coercing tenure to a number (form / raw input)."""
    require_columns(df, col)
    out = df.withColumn(col, trim_to_double(col)) if dict(df.dtypes)[col] == "string" else df
    return bin_tenure(out, col, new_col)


def bin_score(df: DataFrame, col: str = "churn_score", new_col: str = "churn_score_band"
              ) -> DataFrame:
    return bin_column(df, col, new_col, SCORE_EDGES, SCORE_LABELS)


def bin_value(df: DataFrame, col: str = "cltv", new_col: str = "customer_value"
              ) -> DataFrame:
    """Customer value bands 0-3000-4000-5000-max; the top band is open."""
    return bin_column(df, col, new_col, list(VALUE_EDGES) + [float("inf")],
                      VALUE_LABELS, open_top=True)


def bin_all(df: DataFrame) -> DataFrame:
    """The three customer bins in one projection."""
    return bin_value(bin_score(bin_tenure(df)))
