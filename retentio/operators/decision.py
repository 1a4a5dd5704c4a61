"""Decision operators (survey §2.8): profit curve, confusion, metrics,
ROC-AUC, scoring, A/B/C assignment and readout.

Scale notes
-----------
* ``profit_curve`` is O(N), not O(901 N): each score is bucketed by how
  many grid thresholds lie strictly below it, the data is aggregated to at
  most 902 bucket rows (partial aggregation, one tiny shuffle), and the
  confusion counts for every threshold are suffix sums over those rows.
* ``roc_auc`` is the Mann-Whitney rank sum with tied scores averaged:
  scores are aggregated to distinct values and the "negatives below" prefix
  sums run over a range partitioning (``quantiles.prefix_sums``), so partitions
  stay even however the scores pile up.
* ``abc_assign`` hashes the key with the seed (md5), so groups do not
  depend on partitioning, retries or executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import md5_bucket
from .clean import require_columns
from .quantiles import prefix_sums

# Threshold grid 0.050 .. 0.950 step 0.001 (901 values).
GRID_LO, GRID_HI, GRID_STEP_PER_MILLE = 50, 950, 1
N_GRID = GRID_HI - GRID_LO + 1

# A/B/C groups and their offers.
GROUPS = ("A (Control)", "B (Price Offer)", "C (Service Offer)")
OFFERS = {"A (Control)": "None (Control)", "B (Price Offer)": "10% Off 1-Year Contract",
          "C (Service Offer)": "6 Months Free Tech Support"}


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def threshold_of(j: Column) -> Column:
    """Grid threshold number ``j`` (0-based) as the double nearest (j+50)/1000."""
    return (j + GRID_LO).cast("double") / F.lit(1000.0)


def threshold_grid(spark: SparkSession) -> DataFrame:
    return spark.range(0, N_GRID).select(F.col("id").cast("int").alias("j")).withColumn(
        "threshold", threshold_of(F.col("j")))


def grid_rank(p: Column) -> Column:
    """Number of grid thresholds strictly below ``p`` (0..901), exactly.

    A ceil estimate, then one flat repair against the exact grid doubles
    (the estimate is off by at most one, in one direction).
    """
    c = F.least(F.greatest(F.ceil(p * 1000).cast("int") - GRID_LO, F.lit(0)), F.lit(N_GRID))
    up = F.when((c < N_GRID) & (threshold_of(c) < p), 1).otherwise(0)
    down = F.when((c > 0) & (threshold_of(c - 1) >= p), 1).otherwise(0)
    return c + up - down


def profit_curve(scored: DataFrame, value, cost: float, retention_rate: float,
                 label: str = "churn_value", proba: str = "churn_probability") -> DataFrame:
    """Profit at each of the 901 thresholds: ``(threshold, tp, fp, fn, tn, profit)``.

    predicted positive = ``proba > threshold``;
    profit = TP (value * rate - cost) - FP cost - FN value; TN is worth 0.
    ``value`` may be a number or a scalar Column (e.g. a median subquery).
    """
    require_columns(scored, label, proba)
    if not isinstance(value, Column) and (value is None or value < 0):
        raise ValueError("value of a retained customer must be >= 0")
    if cost < 0:
        raise ValueError("cost of an offer must be >= 0")
    if not 0 <= retention_rate <= 1:
        raise ValueError("retention rate must lie in [0, 1]")
    spark = scored.sparkSession
    y = F.col(label).cast("int")
    buckets = (scored.filter(F.col(proba).isNotNull() & y.isNotNull())
               .groupBy(grid_rank(F.col(proba)).alias("k"))
               .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    ks = spark.range(0, N_GRID + 1).select(F.col("id").cast("int").alias("k"))
    # bounded: at most 902 rows on both sides and in the window
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = (ks.join(F.broadcast(buckets), "k", "left").fillna(0, ["pos", "neg"])
            .withColumn("pos_ge", F.sum("pos").over(suffix))
            .withColumn("neg_ge", F.sum("neg").over(suffix))
            .withColumn("P", F.sum("pos").over(Window.partitionBy()))
            .withColumn("N", F.sum("neg").over(Window.partitionBy())))
    # predicted positive at threshold j  <=>  k(p) > j  <=>  k >= j + 1
    at = full.select((F.col("k") - 1).alias("j"), "pos_ge", "neg_ge", "P", "N")
    g = threshold_grid(spark).join(at, "j")
    v = _lit_or_col(value)
    tp, fp = F.col("pos_ge"), F.col("neg_ge")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    profit = tp * (v * retention_rate - cost) - fp * cost - fn * v
    return g.select("threshold", tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                    fn.cast("bigint").alias("fn"), tn.cast("bigint").alias("tn"),
                    F.round(profit, 4).alias("profit"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Maximum profit; the smallest threshold wins ties."""
    return (curve.orderBy(F.col("profit").desc(), F.col("threshold").asc()).limit(1)
            .select("threshold", F.col("profit").alias("best_profit")))


def profit_sorted(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.col("profit").desc(), F.col("threshold").asc())


def confusion(scored: DataFrame, label: str = "churn_value", pred: str = "prediction"
              ) -> DataFrame:
    """TN/FP/FN/TP with both classes always present (one row)."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return scored.agg(F.count_if((y == 0) & (p == 0)).alias("tn"),
                      F.count_if((y == 0) & (p == 1)).alias("fp"),
                      F.count_if((y == 1) & (p == 0)).alias("fn"),
                      F.count_if((y == 1) & (p == 1)).alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall = _safe_div(tp, tp + fn)
    precision = _safe_div(tp, tp + fp)
    return cm.select(
        F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"),
        F.round(_safe_div(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
        F.round(_safe_div(2 * precision * recall, precision + recall), 6).alias("f1"))


def roc_auc(scored: DataFrame, label: str = "churn_value", score: str = "churn_probability"
            ) -> DataFrame:
    """Area under the ROC curve, tied scores counted one half (one row).

    NULL when one of the classes has no row.  Counts are multiplied as doubles:
    a product of two class sizes does not fit a bigint.
    """
    y = F.col(label).cast("int")
    s = (scored.filter(F.col(score).isNotNull() & y.isNotNull())
         .groupBy(F.col(score).cast("double").alias("s"))
         .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    ranked = prefix_sums(s.withColumn("g", F.lit(0)), ["g"], "s", "neg", before="neg_below")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.sum(pos) * F.sum(neg)
    return ranked.agg(F.round(F.when(
        pairs > 0, F.sum(pos * (F.col("neg_below") + 0.5 * neg)) / pairs), 6).alias("roc_auc"))


def eval_metrics(scored: DataFrame, label: str = "churn_value",
                 proba: str = "churn_probability", pred: str | None = None) -> DataFrame:
    """recall, precision, accuracy, F1 and ROC-AUC in one row.

    Without ``pred`` the class is ``proba > 0.5`` (the argmax rule).
    """
    src = scored if pred else scored.withColumn(
        "prediction", (F.col(proba) > 0.5).cast("int"))
    m = metrics_from_confusion(confusion(src, label, pred or "prediction"))
    auc = roc_auc(scored, label, proba).first()[0]  # one bounded value
    return m.withColumn("roc_auc", F.lit(auc).cast("double"))


def score(df: DataFrame, threshold: float, proba: str = "churn_probability") -> DataFrame:
    """Intervention flag = ``proba >= threshold`` (0 <= threshold <= 1)."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return df.withColumn("intervention_flag", (F.col(proba) >= threshold).cast("int"))


def rank_scored(df: DataFrame, proba: str = "churn_probability", key: str = "customer_id"
                ) -> DataFrame:
    """All rows by probability, descending (key breaks ties): range shuffle."""
    return df.orderBy(F.col(proba).desc(), F.col(key).asc())


def top_n_scored(df: DataFrame, n=100, proba: str = "churn_probability",
                 key: str = "customer_id") -> DataFrame:
    """First ``n`` rows by probability (bad or <= 0 -> 100): a top-k, not a sort."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        n = 100
    if n <= 0:
        n = 100
    return rank_scored(df, proba, key).limit(n)


def abc_assign(scored: DataFrame, seed: int = 123, key: str = "customer_id") -> DataFrame:
    """Month-to-month customers flagged for intervention, each assigned to
    one of three groups uniformly and independently by a keyed hash."""
    require_columns(scored, "intervention_flag", "contract", key)
    target = scored.filter((F.col("intervention_flag") == 1)
                           & (F.col("contract") == "Month-to-month"))
    g = F.element_at(F.array(*[F.lit(x) for x in GROUPS]), md5_bucket(key, seed, 3) + 1)
    offer = F.create_map(*[x for k, v in OFFERS.items() for x in (F.lit(k), F.lit(v))])
    return (target.withColumn("group", g)
            .withColumn("intervention_details", offer[F.col("group")]))


def group_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("group").agg(F.count(F.lit(1)).alias("customer_count"))


def abc_readout(assigned: DataFrame, outcome: str = "churn_value", value: float | None = None,
                costs: dict[str, float] | None = None) -> DataFrame:
    """Per group: customers, outcome rate, uplift against control (control rate
    minus group rate), the two-proportion z statistic and the offer's money.

    ``profit`` = customers * (uplift * ``value`` - cost of the group's offer),
    ``profit_per_customer`` and ``roi`` = profit / money spent; NULL for the
    control group, without a ``value``, or where nothing is spent.
    """
    per = assigned.groupBy("group").agg(F.count(F.lit(1)).alias("customers"),
                                        F.sum(F.col(outcome).cast("int")).alias("events"))
    ctl = per.filter(F.col("group") == GROUPS[0]).select("customers", "events").first()
    if ctl is None:  # no control rows: no uplift to report
        ctl = (None, None)
    j = per.withColumn("c_n", F.lit(ctl[0]).cast("bigint")).withColumn(
        "c_e", F.lit(ctl[1]).cast("bigint"))
    rate = F.col("events") / F.col("customers")
    c_rate = F.col("c_e") / F.col("c_n")
    pooled = (F.col("events") + F.col("c_e")) / (F.col("customers") + F.col("c_n"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("customers") + 1 / F.col("c_n")))
    cost = F.lit(0.0)
    for group, c in (costs or {}).items():
        cost = F.when(F.col("group") == group, F.lit(float(c))).otherwise(cost)
    treated = F.col("group") != GROUPS[0]
    per_customer = F.when(treated, (c_rate - rate) * F.lit(value).cast("double") - cost)
    return j.select("group", "customers", "events",
                    F.round(rate, 6).alias("rate"),
                    F.round(c_rate - rate, 6).alias("uplift"),
                    F.round(F.when(treated & (se > 0), (c_rate - rate) / se), 6).alias("z"),
                    F.round(per_customer * F.col("customers"), 4).alias("profit"),
                    F.round(per_customer, 6).alias("profit_per_customer"),
                    F.round(F.when(cost > 0, per_customer / cost), 6).alias("roi"))
