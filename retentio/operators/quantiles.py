"""Exact quantiles and prefix sums without single-task state.

``percentile``/``median`` merge one map of distinct values per group in one
task.  Here the values of all columns (and groups) are counted first - partial
aggregation combines repeated values - and only that table of distinct values
is ordered:

1. counts per (group, column, value);
2. a range partitioning on (group, column, value), written once: every
   partition holds a similar number of distinct values, however they are
   distributed and whatever their range;
3. partition totals (one row per partition and group) give each partition its
   offset, a window inside the partition gives the rest;
4. the rows holding the two order statistics around each quantile are picked
   and interpolated linearly, as ``percentile`` and pandas do.

That serves grouped quantiles.  For whole columns the wanted ranks are bracketed
by mergeable sketches instead (:func:`quantile_values`): no table is written, and
all columns share their passes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SKETCH = 400        # size parameter of the sketch: a rank is off by less than 1 % nearly always
SLACK = 0.02        # on either side of a wanted rank, as a share of a bracket's rows
COLLECTED = 20_000  # values of a bracket that may be fetched


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, value: str,
                before: str = "before", total: str = "total") -> DataFrame:
    """Add, per ``by`` group, the sum of ``value`` over rows with a smaller
    ``order`` and over the whole group.  (``by``, ``order``) must be unique."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *by, order)
                         .withColumn("_part", F.spark_partition_id()))
    per = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    # at most one row per partition and group, plus one per group
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(c).alias(f"_o_{i}") for i, c in enumerate((*by, "_part"))],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_sum").over(Window.partitionBy(*by)).alias(total))
    same = functools.reduce(lambda x, y: x & y, [
        F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, c in enumerate((*by, "_part"))])
    inside = (Window.partitionBy(*by, "_part").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier_here = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.join(per, same).withColumn(before, F.col("_off") + earlier_here).select(
        *df.columns, before, total)


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, prob, quantile)``: exact, linearly interpolated.

    NULL and NaN are ignored, infinities are values, NULL is a group of its
    own; a (group, column) without a value gives no row.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    long = (df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)],
                      *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(keys, list(cols), "column", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, [*keys, "column"], "value", "n")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    at = ranked.select("*", wanted).withColumn("pos", (F.col("total") - 1) * F.col("prob"))
    end = F.col("before") + F.col("n")
    holds_lo = (F.floor("pos") >= F.col("before")) & (F.floor("pos") < end)
    holds_hi = (F.ceil("pos") >= F.col("before")) & (F.ceil("pos") < end)
    lo = F.max(F.when(holds_lo, F.col("value")))
    hi = F.max(F.when(holds_hi, F.col("value")))
    share = F.max(F.col("pos") - F.floor("pos"))
    got = (at.where(holds_lo | holds_hi).groupBy(*keys, "column", "prob")
           .agg(lo.alias("lo"), hi.alias("hi"), share.alias("share")))
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("share") == 0), F.col("lo")).otherwise(
        F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo")))
    return got.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "column", "prob",
                      value.alias("quantile"))


@dataclass
class _Bracket:
    """Closed interval that holds the value of a wanted rank, with what is known about it."""

    column: str
    rank: int
    low: float
    high: float
    below: int   # values smaller than low
    inside: int

    @property
    def open(self) -> bool:
        return self.low < self.high


def _in(b: _Bracket) -> Column:
    v = F.col(b.column)
    return (v >= b.low) & (v <= b.high)


def _narrowed(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Cut every open bracket by a mergeable sketch of what it holds; two partially aggregated passes."""
    sketches = df.agg(*[F.kll_sketch_agg_double(F.when(_in(b), F.col(b.column)), SKETCH).alias(f"s{i}")
                        for i, b in enumerate(brackets)])
    ends = []
    for i, b in enumerate(brackets):
        at = (b.rank - b.below + 0.5) / b.inside
        ends += [F.kll_sketch_get_quantile_double(f"s{i}", F.lit(float(min(1.0, max(0.0, at + d))))).alias(f"e{i}{n}")
                 for n, d in (("a", -SLACK), ("b", SLACK))]
    row = sketches.select(*ends).first()
    cuts, checks = [], []
    for i, b in enumerate(brackets):
        lo, hi = max(b.low, row[f"e{i}a"]), min(b.high, row[f"e{i}b"])
        if (lo, hi) == (b.low, b.high):  # its ends hold nearly all rows: decide about the upper one
            lo = hi
        cuts.append((lo, hi))
        v = F.when(_in(b), F.col(b.column))
        checks += [F.count_if(v < lo).alias(f"n{i}"), F.count_if((v >= lo) & (v <= hi)).alias(f"m{i}"),
                   F.max(F.when(v < lo, v)).alias(f"p{i}"), F.min(F.when(v > hi, v)).alias(f"q{i}")]
    got = df.agg(*checks).first()
    for i, (b, (lo, hi)) in enumerate(zip(brackets, cuts)):
        left, middle = got[f"n{i}"], got[f"m{i}"]
        if b.rank < b.below + left:                # a sketch can miss: the neighbouring part holds the rank
            b.high, b.inside = got[f"p{i}"], left
        elif b.rank < b.below + left + middle:
            b.low, b.high, b.below, b.inside = lo, hi, b.below + left, middle
        else:
            b.low, b.below, b.inside = got[f"q{i}"], b.below + left + middle, b.inside - left - middle


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = COLLECTED
                    ) -> dict[tuple[str, float], float | None]:
    """(column, prob) -> exact, linearly interpolated quantile of the whole table; None without a value.

    NULL and NaN are ignored, infinities are values.  Every wanted rank starts
    with the column's range as its bracket.  Brackets that hold more than
    ``limit`` values are narrowed: a mergeable sketch of their content names an
    interval around the rank (a 25th of the rows or so), a second pass counts
    what lies below and inside.  A sketch that missed only costs another round.
    The counted values of small brackets are fetched, at most ``limit`` each.
    """
    names = list(dict.fromkeys(cols))
    safe = {c: f"_q{i}" for i, c in enumerate(names)}
    number = {c: F.col(c).cast("double") for c in names}
    src = df.select(*[F.when(~F.isnan(v), v).alias(safe[c]) for c, v in number.items()])
    seen = src.agg(*[f(safe[c]).alias(f"{n}{safe[c]}") for c in names for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]
                   ).first() if names else None
    brackets: dict[tuple[str, int], _Bracket] = {}
    for c in names:
        n = seen[f"n{safe[c]}"]
        for p in probs if n else ():
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                brackets[c, rank] = _Bracket(safe[c], rank, seen[f"a{safe[c]}"], seen[f"b{safe[c]}"], 0, n)
    while large := [b for b in brackets.values() if b.open and b.inside > limit]:
        for at in range(0, len(large), 32):  # a bounded number of aggregates per pass
            _narrowed(src, large[at: at + 32])
    found = _picked(src, [b for b in brackets.values() if b.open])
    out: dict[tuple[str, float], float | None] = {}
    for c in names:
        n = seen[f"n{safe[c]}"]
        for p in probs:
            if not n:
                out[c, p] = None
                continue
            pos = (n - 1) * p
            lo, hi = (found.get(id(b), b.low) for b in (brackets[c, math.floor(pos)], brackets[c, math.ceil(pos)]))
            share = pos - math.floor(pos)
            out[c, p] = lo if lo == hi or share == 0 else lo + share * (hi - lo)
    return out


def _picked(src: DataFrame, brackets: list[_Bracket]) -> dict[int, float]:
    """The values at the ranks of small brackets, from the counted values inside them."""
    if not brackets:
        return {}
    spans = {(b.column, b.low, b.high) for b in brackets}
    wanted = functools.reduce(lambda x, y: x | y, [
        (F.col("column") == c) & F.col("value").between(lo, hi) for c, lo, hi in sorted(spans)])
    columns = sorted({b.column for b in brackets})
    counted = (src.select(*columns).unpivot([], columns, "column", "value").where(wanted)
               .groupBy("column", "value").agg(F.count("*").alias("n")).toPandas().sort_values(["column", "value"]))
    out = {}
    for b in brackets:
        part = counted[(counted["column"] == b.column) & (counted["value"] >= b.low) & (counted["value"] <= b.high)]
        ends = b.below + part["n"].cumsum().to_numpy()
        out[id(b)] = float(part["value"].to_numpy()[int((ends > b.rank).argmax())])
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """The quantiles of one column as numbers."""
    got = quantile_values(df, [col], [float(p) for p in probs])
    return [got[col, float(p)] for p in probs]


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """The median of each column."""
    got = quantile_values(df, cols, [0.5])
    return {c: got[c, 0.5] for c in cols}
