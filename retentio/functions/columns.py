"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (pandas NaN is SQL NULL here)."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def trim_to_double(c: str | Column) -> Column:
    """text -> trim -> '' / 'nan' / bad -> NULL -> DOUBLE."""
    return nan_to_null(F.trim(col_(c).cast("string")).try_cast("double"))


def coerce_double(c: str | Column) -> Column:
    """Form input -> DOUBLE; '' and bad text -> NULL."""
    return trim_to_double(c)


def coerce_int(c: str | Column) -> Column:
    """Form input -> INT; '' and bad text -> NULL (no silent truncation of
    non-integral text: '1.5' is rejected like ``int('1.5')`` is)."""
    return F.trim(col_(c).cast("string")).try_cast("int")


def right_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str],
                     include_lowest: bool = True, open_top: bool = False) -> Column:
    """Label of the interval ``(lo, hi]`` holding ``c``.

    The first interval also holds its low edge when ``include_lowest``.
    Values outside the edges, or NULL, give NULL.  With ``open_top`` the
    last interval is ``(lo, +inf)``.  Duplicate edges are dropped.
    """
    e = sorted(set(float(x) for x in edges))
    if len(labels) != len(e) - 1:
        raise ValueError(f"{len(labels)} labels for {len(e) - 1} intervals")
    c = col_(c)
    out = None
    for i, lab in enumerate(labels):
        lo, hi = e[i], e[i + 1]
        low_ok = (c >= lo) if (i == 0 and include_lowest) else (c > lo)
        last = i == len(labels) - 1
        cond = low_ok if (last and open_top) else (low_ok & (c <= hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(None).cast("string"))


def right_closed_bin_index(c: str | Column, edges: Sequence[float],
                           include_lowest: bool = True) -> Column:
    """1-based interval number for ``(lo, hi]`` bins (order column for labels)."""
    e = sorted(set(float(x) for x in edges))
    c = col_(c)
    out = None
    for i in range(len(e) - 1):
        lo, hi = e[i], e[i + 1]
        low_ok = (c >= lo) if (i == 0 and include_lowest) else (c > lo)
        cond = low_ok & (c <= hi)
        out = F.when(cond, F.lit(i + 1)) if out is None else out.when(cond, F.lit(i + 1))
    return out.otherwise(F.lit(None).cast("int"))


def md5_bucket(key: str | Column, seed: int, buckets: int) -> Column:
    """Stable pseudo-random bucket of a key: independent of partitioning.

    ``conv(first 8 hex digits of md5(key|seed), 16, 10) % buckets``; DuckDB
    gives the same with ``('0x' || substr(md5(...), 1, 8))::BIGINT % buckets``.
    """
    digest = F.md5(F.concat_ws("|", col_(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"),
                  F.lit(buckets)).cast("int")


def md5_unit(key: str | Column, seed: int) -> Column:
    """Stable uniform number in [0, 1) from a key and a seed."""
    digest = F.md5(F.concat_ws("|", col_(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def reference_probability() -> Column:
    """Classifier-free churn probability on mart columns.

    A fixed logistic expression, used where a job needs scores whose exact
    values an SQL oracle can reproduce (profit curve, metrics, scoring).
    Fixed values: z = -2.5 + 0.05*churn_score - 0.02*tenure_months
    + 0.8*[contract = 'Month-to-month']; p = round(1/(1+exp(-z)), 6).
    """
    z = (F.lit(-2.5) + F.lit(0.05) * F.col("churn_score")
         - F.lit(0.02) * F.col("tenure_months")
         + F.when(F.col("contract") == "Month-to-month", F.lit(0.8)).otherwise(F.lit(0.0)))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


REFERENCE_PROBABILITY_SQL = (
    "round(1.0 / (1.0 + exp(-(-2.5 + 0.05 * churn_score - 0.02 * tenure_months"
    " + CASE WHEN contract = 'Month-to-month' THEN 0.8 ELSE 0.0 END))), 6)"
)
