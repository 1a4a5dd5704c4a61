"""Projections, filters, predicates and cleaning (survey §2.2).

All operators are lazy DataFrame transforms.  Column names are validated
against ``df.columns`` before planning so errors surface as ``KeyError``
like the reference's contract, not as analysis exceptions deep in a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trim_to_double


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"Column(s) {missing} not found. Available columns: {df.columns}.")


def replace_values(df: DataFrame, col: str, old, new) -> DataFrame:
    """Replace one value, or any of a list of values, in one column."""
    require_columns(df, col)
    olds = list(old) if isinstance(old, (list, tuple, set)) else [old]
    c = F.col(col)
    cond = c.isin(*[o for o in olds if o is not None])
    if any(o is None for o in olds):
        cond = cond | c.isNull()
    return df.withColumn(col, F.when(cond, F.lit(new)).otherwise(c))


def _is_missing(df: DataFrame, name: str) -> Column:
    dtype = dict(df.dtypes)[name]
    c = F.col(name)
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_mask(df: DataFrame, *cols: str, keep: Sequence[str] = ()) -> DataFrame:
    """Boolean missing mask for all columns (default) or the given ones.

    ``keep`` columns (e.g. the row key) are carried through unchanged so the
    mask stays joinable: Spark has no row index.
    """
    names = list(cols) or [c for c in df.columns if c not in keep]
    require_columns(df, *names, *keep)
    return df.select(*[F.col(k) for k in keep],
                     *[_is_missing(df, n).alias(n) for n in names])


def null_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Missing count per column as a long table ``(column, null_count)``.

    One pass: a single global aggregate with one ``count_if`` per column
    (partial aggregation per task, one tiny shuffle), then unpivoted.
    """
    names = list(cols) or list(df.columns)
    require_columns(df, *names)
    wide = df.agg(*[F.count_if(_is_missing(df, n)).alias(n) for n in names])
    return wide.unpivot([], names, "column", "null_count")


def filter_project(df: DataFrame, condition: Column, cols: str | Sequence[str] | None = None
                   ) -> DataFrame:
    """Rows satisfying ``condition``, then the given column(s)."""
    out = df.filter(condition)
    if cols is None:
        return out
    names = [cols] if isinstance(cols, str) else list(cols)
    require_columns(df, *names)
    return out.select(*names)


def drop_columns(df: DataFrame, labels: str | Iterable[str]) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    names = [labels] if isinstance(labels, str) else list(labels)
    return df.drop(*names)


def drop_rows_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose ``key`` is in ``keys``; unknown keys are ignored.

    A left-anti join; whether the key set is broadcast is Catalyst's byte-size
    decision (or AQE's, from the measured size).
    """
    require_columns(df, key)
    k = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    return df.join(k, on=key, how="left_anti")


def parse_total_charges(df: DataFrame, src: str = "total_charges_raw",
                        dst: str = "total_charges") -> DataFrame:
    """trim_to_double: text -> strip -> ''/'nan'/bad -> NULL -> DOUBLE."""
    require_columns(df, src)
    out = df.withColumn(dst, trim_to_double(src))
    return out.drop(src) if src != dst else out


def fill_total_charges(df: DataFrame, total: str = "total_charges",
                       monthly: str = "monthly_charges", tenure: str = "tenure_months"
                       ) -> DataFrame:
    """Missing total = monthly x tenure (same-row expression, no join)."""
    require_columns(df, total, monthly, tenure)
    return df.withColumn(total, F.coalesce(F.col(total), F.col(monthly) * F.col(tenure)))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values of ``col`` (ties: value asc).

    ``groupBy().count()`` is partially aggregated per task, so a hot value
    (even a third of all rows) is combined map-side before the shuffle; the
    result is bounded by ``k`` rows and safe to broadcast.
    """
    return (df.filter(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.col("count").desc(), F.col(col).asc()).limit(k).select(col))


def topk_other(df: DataFrame, col: str = "city", k: int = 20, other: str = "Other"
               ) -> DataFrame:
    """Keep the ``k`` most frequent values; all others, and NULL, -> ``other``."""
    require_columns(df, col)
    top = top_values(df, col, k).withColumn("_keep", F.lit(True))
    joined = df.join(F.broadcast(top), on=col, how="left")  # bounded: k rows
    return joined.withColumn(
        col, F.when(F.col("_keep"), F.col(col)).otherwise(F.lit(other))
    ).drop("_keep").select(*df.columns)


def topk_isin(df: DataFrame, col: str = "city", k: int = 20) -> DataFrame:
    """Rows whose ``col`` is among the ``k`` most frequent values."""
    require_columns(df, col)
    return df.join(F.broadcast(top_values(df, col, k)), on=col, how="left_semi")


def filter_churned(df: DataFrame, min_tenure: int | None = None) -> DataFrame:
    """Churned customers; optionally only those with tenure >= ``min_tenure``."""
    out = df.filter(F.col("churn_value") == 1)
    if min_tenure is not None:
        out = out.filter(F.col("tenure_months") >= min_tenure)
    return out


def clean_customers(df: DataFrame, top_k: int = 20,
                    drop: Sequence[str] = ("count", "country", "lat_long", "churn_label")
                    ) -> DataFrame:
    """Composite cleaning: parse total charges, fill from monthly x tenure,
    group rare cities into 'Other', drop constant/leaky columns.

    The customer key is kept (Spark has no row index to align on).
    """
    out = parse_total_charges(df)
    out = fill_total_charges(out)
    out = topk_other(out, "city", top_k)
    return drop_columns(out, drop)


def head(df: DataFrame, n=5, order_by: str | None = None) -> DataFrame:
    """First ``n`` rows (n < 0 or not an int -> 5), in an explicit order."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        n = 5
    ordered = df.orderBy(order_by) if order_by else df
    return ordered.limit(n)
