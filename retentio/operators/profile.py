"""Aggregations and profiles (survey §2.4).

Every profile is one ``agg``/``groupBy`` pass: partial aggregation per task
combines hot keys map-side before the shuffle, and each result is bounded
by the number of columns, statistics, bins or distinct categories.  Wide
one-row results are unpivoted to long tables for display/joins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import require_columns
from .quantiles import medians, quantile_values

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")

# Aggregate names accepted by the named-aggregate operators.
AGG_NAMES = ("mean", "median", "sum", "min", "max", "std", "var", "count", "nunique")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


NUMERIC_ONLY = ("mean", "median", "sum", "std", "var")


def check_aggregates(df: DataFrame, plan: Mapping[str, Sequence[str]]) -> None:
    """ValueError when a numeric aggregate is asked of a non-numeric column."""
    dtypes = dict(df.dtypes)
    for c, fns in plan.items():
        for f in fns:
            if f not in AGG_NAMES:
                raise ValueError(f"unknown aggregate {f!r}; known: {AGG_NAMES}")
            t = dtypes[c]
            if f in NUMERIC_ONLY and not (t in NUMERIC or t.startswith("decimal")):
                raise ValueError(f"aggregate {f!r} is incompatible with {c!r} ({t})")


def agg_expr(name: str, col: str) -> Column:
    """Spark aggregate for a pandas-style aggregate name."""
    c = F.col(col)
    if name == "mean":
        return F.avg(c)
    if name == "sum":
        return F.sum(c)
    if name == "min":
        return F.min(c)
    if name == "max":
        return F.max(c)
    if name == "std":
        return F.stddev_samp(c)
    if name == "var":
        return F.var_samp(c)
    if name == "count":
        return F.count(c)
    if name == "nunique":
        return F.count_distinct(c)
    raise ValueError(f"unknown aggregate {name!r}; known: {AGG_NAMES}")


def _literals(df: DataFrame, plan: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Medians asked for by ``plan`` as literals (one number per column)."""
    asked = [c for c, fns in plan.items() if "median" in fns]
    return {c: F.lit(v).cast("double") for c, v in medians(df, asked).items()} if asked else {}


def agg_named(df: DataFrame, func: str, cols: str | Sequence[str] | None = None
              ) -> DataFrame:
    """One aggregate over one, several or all (numeric) columns: one row."""
    names = [cols] if isinstance(cols, str) else list(cols or numeric_columns(df))
    require_columns(df, *names)
    check_aggregates(df, {c: [func] for c in names})
    if func == "median":
        ready = _literals(df, {c: [func] for c in names})
        return df.sparkSession.range(1).select(*[ready[c].alias(c) for c in names])
    return df.agg(*[agg_expr(func, c).alias(c) for c in names])


def _stack_aggregates(df: DataFrame, plan: Mapping[str, Sequence[str]]) -> DataFrame:
    """Run ``{column: [aggregate, ...]}`` in one pass; return a long matrix
    with one row per aggregate and one DOUBLE column per input column
    (NULL where an aggregate was not requested for a column)."""
    funcs: list[str] = []
    for fns in plan.values():
        for f in fns:
            if f not in funcs:
                funcs.append(f)
    ready = _literals(df, plan)
    exprs = [agg_expr(f, c).cast("double").alias(f"{f}__{c}")
             for c, fns in plan.items() for f in fns if f != "median"]
    wide = df.agg(*exprs) if exprs else df.sparkSession.range(1)

    def cell(f: str, c: str) -> Column:
        if f not in plan[c]:
            return F.lit(None).cast("double")
        return ready[c] if f == "median" else F.col(f"{f}__{c}")

    rows = [F.struct(F.lit(f).alias("aggregate"), *[cell(f, c).alias(c) for c in plan])
            for f in funcs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def agg_list(df: DataFrame, funcs: Sequence[str], cols: Sequence[str] | None = None
             ) -> DataFrame:
    """Several aggregates x columns -> matrix (row per aggregate)."""
    names = list(cols or numeric_columns(df))
    require_columns(df, *names)
    check_aggregates(df, {c: list(funcs) for c in names})
    return _stack_aggregates(df, {c: list(funcs) for c in names})


def agg_dict(df: DataFrame, spec: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Different aggregates per column -> matrix (row per aggregate)."""
    require_columns(df, *spec)
    plan = {c: ([f] if isinstance(f, str) else list(f)) for c, f in spec.items()}
    check_aggregates(df, plan)
    return _stack_aggregates(df, plan)


@dataclass(frozen=True)
class Aggregator:
    """A user aggregate in four steps, so that partial results can be combined.

    ``init()`` gives an empty state, ``update(state, values)`` adds a pandas
    Series without missing values, ``merge(a, b)`` joins two states and
    ``finish(state)`` gives the number.  States should stay small: one per task
    and column is shuffled.
    """

    init: Callable[[], object]
    update: Callable[[object, pd.Series], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], float]


def _decomposed(fn: Callable[[pd.Series], float]) -> Aggregator:
    def add(a, b):
        return b if a is None else a if b is None else float(fn(pd.Series([a, b])))

    return Aggregator(lambda: None, lambda s, v: add(s, float(fn(v))) if len(v) else s, add,
                      lambda s: float("nan") if s is None else s)


def agg_callable(df: DataFrame, fn: Aggregator | Callable[[pd.Series], float],
                 cols: str | Sequence[str], decomposable: bool = False,
                 merge_groups: int = 64) -> DataFrame:
    """A user aggregate per column: one row, DOUBLE columns (NaN without values).

    Every task folds its rows into one state per column; states are merged in
    ``merge_groups`` groups and those once more, so no task holds a column.
    A plain function says nothing about how partial results combine, so it is
    accepted only with ``decomposable=True`` (``fn`` of partial results equals
    ``fn`` of the whole, as for max, min, sum); anything else - a range, a
    variance, a count - is an ``Aggregator``.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    require_columns(df, *names)
    if not isinstance(fn, Aggregator):
        if not decomposable:
            raise TypeError("pass an Aggregator, or decomposable=True when the function of partial "
                            "results equals the function of all values")
        fn = _decomposed(fn)

    def partial(batches):
        states = {c: fn.init() for c in names}
        for b in batches:
            for c in names:
                values = b[c].dropna()
                if len(values):
                    states[c] = fn.update(states[c], values)
        yield pd.DataFrame({"column": names, "state": [pickle.dumps(states[c]) for c in names]})

    def merged(pdf: pd.DataFrame) -> object:
        state = fn.init()
        for raw in pdf["state"]:
            state = fn.merge(state, pickle.loads(raw))
        return state

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"column": pdf["column"][:1], "state": [pickle.dumps(merged(pdf))]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"column": pdf["column"][:1], "value": [float(fn.finish(merged(pdf)))]})

    src = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    states = src.mapInPandas(partial, "column string, state binary")
    grouped = states.withColumn("_g", F.pmod(F.xxhash64("state", F.spark_partition_id()),
                                             F.lit(merge_groups)))
    halfway = grouped.groupBy("column", "_g").applyInPandas(combine, "column string, state binary")
    out = halfway.groupBy("column").applyInPandas(finish, "column string, value double")
    return out.groupBy().pivot("column", names).agg(F.first("value")).select(*names)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct value -> count, descending (ties by value); NULL dropped."""
    require_columns(df, col)
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


def value_counts_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for many columns in ONE shuffle:
    unpivot to long, then a single ``groupBy(column, value)``."""
    require_columns(df, *cols)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    return (long.filter(F.col("value").isNotNull()).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("count")))


def few_distinct(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct non-NULL values of each column, counted exactly up to ``limit`` (which then means "or more").

    Every task keeps the ``limit`` smallest values of a column and lets go of
    the rest, so a state never grows and no row is copied per column; the
    smallest values of all tasks together decide (at most ``limit`` rows per
    column and task are shuffled).
    """
    require_columns(df, *cols)
    names = list(dict.fromkeys(cols))

    def smallest(batches):
        kept: list[set] = [set() for _ in names]
        for b in batches:
            for i, c in enumerate(b.columns):
                kept[i] = set(sorted(kept[i].union(v for v in c.unique().to_pylist() if v is not None))[:limit])
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, k in enumerate(kept) for _ in k], pa.int32()),
             pa.array([v for k in kept for v in sorted(k)], pa.string())], names=["i", "v"])

    rows = (df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
            .mapInArrow(smallest, "i int, v string").distinct().groupBy("i").count().collect())  # one row per column
    got = {r["i"]: min(limit, r["count"]) for r in rows}
    return {c: got.get(i, 0) for i, c in enumerate(names)}


def count_distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cardinality per column (NULL not counted) as ``(column, n_distinct)``.

    Exact distinct counts over many columns in one aggregate plan as an
    Expand (one copy of each row per column, de-duplicated map-side).
    """
    names = list(cols or df.columns)
    require_columns(df, *names)
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in names])
    return wide.unpivot([], names, "column", "n_distinct")


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, mode)``: the most frequent value as text; NULL ignored.

    Ties go to the smallest value: numbers compare as numbers, text as text.
    Two partially aggregated levels instead of the ``mode`` aggregate, whose
    merge holds every distinct value of a group in one task: counts per
    (group, column, value) are spread over all tasks, then ``min_by`` reduces
    each task's candidates to one per group and column.
    """
    require_columns(df, *cols, *by)
    keys = [f"_k{i}" for i in range(len(by))]
    numeric = [c for c in cols if c in numeric_columns(df)]
    entry = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                      (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double"))
                      .alias("number")) for c in cols]
    long = (df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)],
                      F.explode(F.array(*entry)).alias("e"))
            .select(*keys, "e.*").where(F.col("value").isNotNull()))
    counts = long.groupBy(*keys, "column", "value", "number").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys, "column").agg(
        F.min_by("value", F.struct((-F.col("_n")).alias("neg_n"), "number", "value")).alias("mode"))
    return best.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "column", "mode")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25%, 50%, 75% (interpolated), max.

    Exact quartiles by ``quantiles.quantile_values`` (three numbers per column
    become literals), the other statistics in one aggregate pass.  Result is
    row-per-statistic.
    """
    names = list(cols or numeric_columns(df))
    require_columns(df, *names)
    quartiles = quantile_values(df, names, [0.25, 0.5, 0.75])
    exprs = []
    for c in names:
        x = F.col(c).cast("double")
        exprs += [F.count(x).cast("double").alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                  F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"),
                  F.max(x).alias(f"max__{c}")]
    wide = df.agg(*exprs)
    share = {"25%": 0.25, "50%": 0.5, "75%": 0.75}

    def val(stat: str, c: str) -> Column:
        if stat in share:
            return F.lit(quartiles.get((c, share[stat]))).cast("double")
        return F.col(f"{stat}__{c}")

    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    rows = [F.struct(F.lit(s).alias("statistic"), *[val(s, c).alias(c) for c in names])
            for s in stats]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def info(df: DataFrame) -> DataFrame:
    """``(column, position, dtype, non_null)`` for every column."""
    names = df.columns
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in names])
    long = counts.unpivot([], names, "column", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(c, i, t) for i, (c, t) in enumerate(df.dtypes)],
        "column string, position int, dtype string")
    return meta.join(F.broadcast(long), "column")  # both sides: one row per column


def bin_range(lo: float | None, hi: float | None) -> tuple[float, float]:
    """Histogram range: (0, 1) without values, a constant widened by 0.5 per side."""
    if lo is None or hi is None:
        return 0.0, 1.0
    return (float(lo) - 0.5, float(hi) + 0.5) if lo == hi else (float(lo), float(hi))


def bin_edges(lo: float, hi: float, n: int, i: int) -> tuple[float, float]:
    """Edges of the 0-based bin ``i`` of ``n``."""
    step = (hi - lo) / float(n)
    return float(i) * step + lo, hi if i + 1 >= n else float(i + 1) * step + lo


def equal_width_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """1-based number of the bin holding ``v`` (``[lo, hi)``, the last closed).

    A floor estimate, then one flat repair against the exact edge values (the
    estimate is off by at most one bin, in one direction).
    """
    low, high = F.lit(lo), F.lit(hi)
    step = (high - low) / F.lit(float(n))

    def edge(i: Column) -> Column:
        return F.when(i >= n, high).otherwise(i.cast("double") * step + low)

    k0 = F.least(F.floor((v - low) * (F.lit(float(n)) / (high - low))).cast("int"), F.lit(n - 1))
    down = F.when(v < edge(k0), 1).otherwise(0)
    up = F.when((v >= edge(k0 + 1)) & (k0 != n - 1), 1).otherwise(0)
    return k0 - down + up + 1


def histogram(df: DataFrame, col: str, bins: int = 20, hue: str | None = None,
              edges: Sequence[float] | None = None,
              value_range: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Equal-width histogram with empty bins; optional hue split.

    Bins are ``[lo, hi)`` and the last is ``[lo, hi]`` (numpy rule).  The
    column's (min, max) is one bounded aggregate row (or ``value_range`` when
    already known, e.g. computed for many charts in one pass); the bin number
    is arithmetic on those literals, repaired against the exact edge values,
    so no sort or range join is needed.  Output ``(hue, bin, bin_lo, bin_hi,
    count)``; ``hue`` is NULL when no split is asked.  All bins x all hue
    values are emitted.
    """
    require_columns(df, col, *([hue] if hue else []))
    v = F.col(col).cast("double")
    src = df.filter(v.isNotNull() & ~F.isnan(v))
    if edges is not None:
        e = sorted(float(x) for x in edges)
        n = len(e) - 1
        idx = None
        for i in range(n):
            cond = (v >= e[i]) & ((v <= e[i + 1]) if i == n - 1 else (v < e[i + 1]))
            idx = F.when(cond, F.lit(i + 1)) if idx is None else idx.when(cond, F.lit(i + 1))
        binned = src.withColumn("bin", idx).filter(F.col("bin").isNotNull())
        grid = df.sparkSession.createDataFrame(
            [(i + 1, e[i], e[i + 1]) for i in range(n)], "bin int, bin_lo double, bin_hi double")
    else:
        n = bins
        # one bounded row (min, max) fetched once; literals afterwards, so the
        # range is not re-evaluated by a subquery per reference
        st = (dict(zip(("mn", "mx"), value_range)) if value_range is not None
              else src.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).first())
        lo, hi = bin_range(st["mn"], st["mx"])
        binned = src.withColumn("bin", equal_width_bin(v, lo, hi, n))
        grid = df.sparkSession.createDataFrame(
            [(i + 1, *bin_edges(lo, hi, n, i)) for i in range(n)],
            "bin int, bin_lo double, bin_hi double")
    if hue:
        # one pass: per hue value (NULL is one) the counts of its bins, as a
        # map of at most n entries; rows without a number or outside the edges
        # fall in bin 0, which keeps their hue value in the result
        place = idx if edges is not None else equal_width_bin(v, lo, hi, n)
        cells = (df.select(F.col(hue).alias("hue"),
                           F.coalesce(F.when(v.isNotNull() & ~F.isnan(v), place), F.lit(0)).alias("bin"))
                 .groupBy("hue", "bin").agg(F.count(F.lit(1)).alias("count")))
        per_hue = cells.groupBy("hue").agg(F.map_from_entries(F.collect_list(
            F.struct("bin", "count"))).alias("_c"))
        out = (per_hue.select("hue", "_c", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"))
               .withColumn("count", F.coalesce(F.col("_c")[F.col("bin")], F.lit(0)))
               .join(F.broadcast(grid), "bin"))  # grid: n rows
    else:
        counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
        out = grid.join(counts, "bin", "left").withColumn("hue", F.lit(None))
    return out.select(F.col("hue").cast("string").alias("hue"), "bin",
                      F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def count_by(df: DataFrame, col: str, hue: str | None = None,
             order: Sequence[str] | None = None) -> DataFrame:
    """Bar heights: ``(category, hue, count)``.

    Missing values become the category 'nan' (the reference casts to text
    first).  With ``order``, only those categories are kept and a
    ``position`` column follows the list.
    """
    require_columns(df, col, *([hue] if hue else []))
    cat = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    h = F.coalesce(F.col(hue).cast("string"), F.lit("nan")) if hue else F.lit(None).cast(
        "string")
    counts = df.groupBy(cat.alias("category"), h.alias("hue")).agg(
        F.count(F.lit(1)).alias("count"))
    if order is not None:
        pos = F.create_map(*[x for i, o in enumerate(order) for x in (F.lit(str(o)), F.lit(i + 1))])
        return counts.withColumn("position", pos[F.col("category")]).filter(
            F.col("position").isNotNull())
    return counts


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric pair, pairwise complete.

    Every task reduces its rows to one block of co-moments per pair (count,
    means, squares and product about the means, over the rows where both sides
    are present) by a few matrix products; blocks are merged by the exact
    formula for joined samples.  One scan, d * d rows per task, whatever the
    number of columns.  Output ``(col_a, col_b, r)`` in both orders; NULL where
    a side does not vary.  Raises when there is no numeric column.
    """
    names = list(cols or numeric_columns(df))
    if not names:
        raise ValueError("no numeric column to correlate")
    require_columns(df, *names)
    d = len(names)

    def blocks(batches):
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) if b.num_rows else None
            if x is None:
                continue
            one = co_moments(x, np.column_stack([~np.asarray(c.is_null()) for c in b.columns]))
            total = one if total is None else joined_moments(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(d), d), pa.int32()), pa.array(np.tile(np.arange(d), d), pa.int32()),
                 *(pa.array(m.ravel(), pa.float64()) for m in total)], names=["a", "b", *MOMENTS])

    parts = (df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
             .mapInArrow(blocks, "a int, b int, " + ", ".join(f"{m} double" for m in MOMENTS)))
    whole = parts.groupBy("a", "b").agg(F.collect_list(F.struct(*MOMENTS)).alias("p"))  # one row per task and pair
    whole = whole.withColumn("n", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["n"]))

    def mean(m: str) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + F.when(x["n"] > 0, x["n"] * x[m]).otherwise(0.0)) / F.col("n")

    def about(c: str, m1: str, m2: str) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + F.when(
            x["n"] > 0, x[c] + x["n"] * (x[m1] - F.col(f"_{m1}")) * (x[m2] - F.col(f"_{m2}"))).otherwise(0.0))

    merged = whole.withColumn("_ma", mean("ma")).withColumn("_mb", mean("mb"))
    xx, yy, xy = about("xx", "ma", "ma"), about("yy", "mb", "mb"), about("xy", "ma", "mb")
    label = F.array(*[F.lit(c) for c in names])
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    got = (merged.where("n > 0").select("a", "b", xx.alias("xx"), yy.alias("yy"), xy.alias("xy"))
           .select("a", "b", F.when(F.isnan(r), None).otherwise(r).alias("r")))
    pairs = (df.sparkSession.range(d * d).select((F.col("id") / d).cast("int").alias("a"), (F.col("id") % d).cast("int").alias("b")))
    return (pairs.join(got, ["a", "b"], "left")
            .select(label[F.col("a")].alias("col_a"), label[F.col("b")].alias("col_b"), F.round("r", 6).alias("r")))


MOMENTS = ("n", "ma", "mb", "xx", "yy", "xy")  # of a pair (a, b): rows, means, squares and product about the means


def co_moments(x: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, ...]:
    """``MOMENTS`` of every pair of columns over the rows where both are present."""
    m = present.astype(float)
    # about a value of each column, so large means do not cancel
    shift = np.array([x[p, i][0] if p.any() else 0.0 for i, p in enumerate(present.T)])
    z = np.where(present, x - shift, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1)
    sa, sb = z.T @ m, m.T @ z
    squares = (z * z).T @ m
    return (n, sa / some + shift[:, None], sb / some + shift[None, :], squares - sa * sa / some,
            squares.T - sb * sb / some, z.T @ z - sa * sb / some)


def joined_moments(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Co-moments of two samples together."""
    n = p[0] + q[0]
    some = np.maximum(n, 1)
    da, db, w = q[1] - p[1], q[2] - p[2], p[0] * q[0] / some
    return (n, p[1] + da * q[0] / some, p[2] + db * q[0] / some, p[3] + q[3] + da * da * w, p[4] + q[4] + db * db * w,
            p[5] + q[5] + da * db * w)


def value_range() -> Aggregator:
    """max - min as an ``Aggregator``."""
    def add(state, values):
        lo, hi = float(values.min()), float(values.max())
        return (lo, hi) if state is None else (min(state[0], lo), max(state[1], hi))

    def merge(a, b):
        if a is None or b is None:
            return a or b
        return min(a[0], b[0]), max(a[1], b[1])

    return Aggregator(lambda: None, add, merge,
                      lambda s: float("nan") if s is None else s[1] - s[0])


def np_max(s: pd.Series) -> float:
    """Example decomposable callable for ``agg_callable``."""
    return float(np.max(s.to_numpy()))


def kde(df: DataFrame, col: str, grid_size: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of ``col`` on an evenly spaced grid.

    Fixed values (public scipy/seaborn defaults): Scott bandwidth
    ``h = std(ddof=1) * n ** (-1/5)``; grid of ``grid_size`` points from
    ``min - cut*h`` to ``max + cut*h``.  Values are counted first; each partition adds
    its distinct values' weighted kernel contributions onto the grid with numpy (``mapInPandas``) and one
    ``groupBy(grid point)`` sums the partials, so the O(N x grid) work is
    spread over all tasks and only ``grid_size`` rows per task are shuffled.
    Output ``(point, x, density)``.
    """
    require_columns(df, col)
    v = F.col(col).cast("double")
    src = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # kernels are summed over distinct values with their counts
    weighted = src.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    st = src.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"),
                 F.min("v").alias("mn"), F.max("v").alias("mx")).first()  # one row
    n, sd = int(st["n"]), st["sd"]
    if n < 2 or not sd:
        raise ValueError("KDE needs at least two distinct values")
    h = float(sd) * float(n) ** (-0.2)
    lo, hi = float(st["mn"]) - cut * h, float(st["mx"]) + cut * h
    step = (hi - lo) / (grid_size - 1)
    grid = lo + np.arange(grid_size, dtype=np.float64) * step
    grid[-1] = hi

    def partial(batches):
        acc = np.zeros(grid_size)
        for b in batches:
            x, w = b["v"].to_numpy(dtype=np.float64), b["w"].to_numpy()
            for s in range(0, len(x), 4096):
                z = (grid[:, None] - x[None, s:s + 4096]) / h
                acc += np.exp(-0.5 * z * z) @ w[s:s + 4096]
        yield pd.DataFrame({"point": np.arange(grid_size, dtype=np.int32), "s": acc})

    sums = weighted.mapInPandas(partial, "point int, s double").groupBy("point").agg(
        F.sum("s").alias("s"))
    norm = float(n) * h * float(np.sqrt(2 * np.pi))
    xs = df.sparkSession.createDataFrame(
        [(i, float(grid[i])) for i in range(grid_size)], "point int, x double")
    return xs.join(sums, "point").select(
        "point", F.round("x", 6).alias("x"), F.round(F.col("s") / norm, 12).alias("density"))
