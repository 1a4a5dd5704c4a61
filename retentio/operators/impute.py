"""Conditional imputation of incomplete customers (survey §2.8).

The reference fills ONE customer from modes and medians of the full table.
Here a whole batch of incomplete rows is filled in one job:

* global modes of every categorical column (two partially aggregated
  levels, one row per column) and the whole-table medians (one aggregate
  row), used as literals;
* conditional modes (child column given a parent value): one
  ``groupBy(parent)`` per dependency, bounded by the parent's cardinality;
* medians of a numeric column per parent value: one ``groupBy(parent)``;
* the batch is joined to those small tables on the (already filled) parent
  value; ``coalesce(given, conditional, global)``.

Only NULL counts as missing unless ``zero_is_missing`` (the reference's
``x or fallback`` also replaces 0 and 0.0).  Medians are rounded half-even in
integer cents so the result does not depend on floating-point formatting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import modes
from .quantiles import medians, quantile_table


# Which parent column each dependent column of the mart is filled from (the
# mart has none of the service columns below).
DEFAULT_DEPENDENCIES = {"payment_method": "internet_service"}
# The dependencies of a customer table with service columns.
SERVICE_DEPENDENCIES = {
    "multiple_lines": "phone_service",
    "online_security": "internet_service",
    "online_backup": "internet_service",
    "device_protection": "internet_service",
    "tech_support": "internet_service",
    "streaming_tv": "internet_service",
    "streaming_movies": "internet_service",
}
DEFAULT_CATEGORICAL = ("city", "contract", "internet_service", "payment_method")


def _missing(c: Column, zero_is_missing: bool, numeric: bool) -> Column:
    if zero_is_missing and numeric:
        return c.isNull() | (c == 0)
    if zero_is_missing:
        return c.isNull() | (c == "")
    return c.isNull()


@dataclass
class ImputationModel:
    """Statistics of a reference table, computed once and reused for any
    number of batches (e.g. every micro-batch of a stream).

    ``globals`` is one bounded row; ``conditional`` holds, per dependent
    column, a table with one row per parent value; ``medians`` one row per
    parent value of the median column.
    """
    globals: dict
    conditional: dict[str, DataFrame]
    medians: DataFrame
    categorical: tuple
    dependencies: dict
    tenure: str
    monthly: str
    total: str
    median_parent: str


def fit_imputation(reference: DataFrame,
                   categorical: Sequence[str] = DEFAULT_CATEGORICAL,
                   dependencies: Mapping[str, str] = DEFAULT_DEPENDENCIES,
                   tenure: str = "tenure_months", monthly: str = "monthly_charges",
                   total: str = "total_charges", median_parent: str = "internet_service",
                   materialize: bool = True) -> ImputationModel:
    """Whole-table modes/medians in ONE aggregate pass, plus the conditional
    tables (one ``groupBy(parent)`` each).  ``materialize`` writes the
    conditional tables once (for reuse across many batches)."""
    cents = F.round(F.col(monthly) * 100).cast("bigint")
    dep_only = [c for c in dependencies if c not in categorical]
    mode_cols = [*categorical, *dep_only]
    # global modes: two-level counts (no single-task map of distinct values);
    # categorical columns are text, so the text tie rule is the value rule
    g = {f"mode_{r['column']}": r["mode"]
         for r in modes(reference, mode_cols).collect()}  # one row per column
    priced = reference.select(tenure, median_parent, cents.alias("_cents"))
    whole = medians(priced, [tenure, "_cents"])
    g.update({"_med_t": whole[tenure], "_med_c": whole["_cents"]})
    for c in mode_cols:
        g.setdefault(f"mode_{c}", None)
    cond = {child: (modes(reference, [child], by=[parent]).select(
                parent, F.col("mode").cast(dict(reference.dtypes)[child]).alias(f"_m_{child}")))
            for child, parent in dependencies.items()}
    med_by = quantile_table(priced, ["_cents"], [0.5], by=[median_parent]).select(
        median_parent, F.col("quantile").alias("_med_c"))
    if materialize:
        from ..session import cut_lineage
        cond = {k: cut_lineage(v) for k, v in cond.items()}
        med_by = cut_lineage(med_by)
    return ImputationModel(g, cond, med_by, tuple(categorical), dict(dependencies), tenure,
                           monthly, total, median_parent)


def apply_imputation(batch: DataFrame, model: ImputationModel,
                     zero_is_missing: bool = False) -> DataFrame:
    """Fill missing fields of ``batch`` from a fitted ``ImputationModel``."""
    m = model
    out = batch
    num = {c for c, t in batch.dtypes if t in ("int", "bigint", "double", "float")}

    def blank(c: str) -> Column:
        return _missing(F.col(c), zero_is_missing, c in num)

    def lit(name: str) -> Column:
        return F.lit(m.globals[name])

    # 1. independent categoricals (parents first): global mode
    dtypes = dict(batch.dtypes)
    for c in m.categorical:
        if c in m.dependencies:
            continue
        fill = lit(f"mode_{c}").cast(dtypes[c])  # modes are computed as text
        out = out.withColumn(c, F.when(blank(c), fill).otherwise(F.col(c)))

    # 2. dependents: mode among reference rows with the same parent value,
    #    the global mode when that parent value has no rows
    for child, parent in m.dependencies.items():
        out = (out.join(m.conditional[child], parent, "left")
               .withColumn(child, F.when(blank(child),
                                         F.coalesce(F.col(f"_m_{child}"),
                                                    lit(f"mode_{child}").cast(dtypes[child])))
                           .otherwise(F.col(child))).drop(f"_m_{child}"))

    # 3. tenure: int(median) of the whole reference
    med_t = None if m.globals["_med_t"] is None else int(m.globals["_med_t"] // 1)
    out = out.withColumn(m.tenure, F.when(blank(m.tenure), F.lit(med_t).cast("int"))
                         .otherwise(F.col(m.tenure)))

    # 4. monthly: median per parent value (2 decimals), whole-table median
    #    when the parent value is unknown
    med_c = F.coalesce(F.col("_med_c"), lit("_med_c"))
    out = (out.join(m.medians, m.median_parent, "left")
           .withColumn(m.monthly, F.when(blank(m.monthly), F.bround(med_c, 0) / 100.0)
                       .otherwise(F.col(m.monthly))).drop("_med_c"))

    # 5. total = monthly x tenure, 2 decimals
    out = out.withColumn(m.total, F.when(blank(m.total),
                                         F.round(F.col(m.monthly) * F.col(m.tenure), 2))
                         .otherwise(F.col(m.total)))
    return out.select(*batch.columns)


def impute_conditional(batch: DataFrame, reference: DataFrame,
                       categorical: Sequence[str] = DEFAULT_CATEGORICAL,
                       dependencies: Mapping[str, str] = DEFAULT_DEPENDENCIES,
                       tenure: str = "tenure_months", monthly: str = "monthly_charges",
                       total: str = "total_charges", median_parent: str = "internet_service",
                       zero_is_missing: bool = False) -> DataFrame:
    """Fill missing fields of ``batch`` from statistics of ``reference``."""
    model = fit_imputation(reference, categorical, dependencies, tenure, monthly, total,
                           median_parent)
    return apply_imputation(batch, model, zero_is_missing)
