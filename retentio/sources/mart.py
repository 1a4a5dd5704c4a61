"""The ``customer_360`` mart: one row per customer with orders.

The base tables are order-level, so the customer table the analytics work on
is derived here with one aggregation of ``orders`` (map-side partial
aggregation, then one shuffle on ``o_custkey``) and two joins:

* ``customer`` (one row per key after the aggregate, so the join is 1:1 and
  skew-free; Catalyst picks broadcast when its statistics fit the
  auto-broadcast threshold and a sort-merge join otherwise), and
* ``nation`` (a dimension table; same size-checked choice).

The reference date ``as_of`` is a scalar subquery (one row by construction):
a one-column scan with partial max per task; no cross join.

Column definitions (fixed for this repository, shared with the DuckDB
oracle in ``retentio.plans.oracle``):

=================== =========================================================
customer_id         c_custkey
city                n_name
tenure_months       floor(days(first order .. last order) / 30)
total_charges_raw   '%.2f' of the spend in cents; '' when key % 97 = 0
monthly_charges     spend cents / greatest(tenure_months, 1), rounded half-up to
                    whole cents in integer arithmetic (engine-independent)
contract            key % 20: <11 Month-to-month, <15 One year, else Two year
internet_service    c_mktsegment
payment_method      most frequent o_orderpriority (smallest on ties)
churn_value         1 when last order is more than 365 days before as_of
churn_score         least(100, floor(days since last order / 10))
cltv                round(c_acctbal + 2000, 0)
=================== =========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

MART_COLUMNS = (
    "customer_id", "city", "tenure_months", "total_charges_raw", "monthly_charges",
    "contract", "internet_service", "payment_method", "churn_value", "churn_score",
    "cltv",
)


def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", "o_custkey", "o_totalprice",
                        "o_orderdate", "o_orderpriority")
    odate = F.to_date("o_orderdate")
    per_cust = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min(odate).alias("first_order"),
        F.max(odate).alias("last_order"),
        F.sum("o_totalprice").alias("spend"),
        # single-pass, partially aggregated mode; ties -> smallest value
        F.mode("o_orderpriority", True).alias("payment_method"),
    )
    # one-column scan with a map-side partial max (one row per task, no
    # shuffle of orders); cheaper than re-deriving it from per_cust, whose
    # pruned copy would not be reused and would shuffle orders again
    as_of = orders.agg(F.max(odate)).scalar()

    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey",
                      "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")

    tenure = F.floor(F.datediff("last_order", "first_order") / 30).cast("int")
    key = F.col("customer_id")
    bucket20 = F.pmod(key, F.lit(20))
    days_idle = F.datediff(as_of, F.col("last_order"))

    cents = F.round(F.col("spend") * 100).cast("bigint")
    months = F.greatest(F.col("tenure_months"), F.lit(1)).cast("bigint")
    monthly_cents = F.expr("(2 * spend_cents + months) div (2 * months)")

    return (
        per_cust.join(cust, per_cust.customer_id == cust.c_custkey)
        .join(nation, cust.c_nationkey == nation.n_nationkey)
        .withColumn("tenure_months", tenure)
        .withColumn("spend_cents", cents)
        .withColumn("months", months)
        .select(
            key,
            F.col("n_name").alias("city"),
            F.col("tenure_months"),
            F.when(F.pmod(key, F.lit(97)) == 0, F.lit(""))
            .otherwise(F.format_string("%.2f", F.col("spend_cents") / 100.0))
            .alias("total_charges_raw"),
            (monthly_cents / 100.0).alias("monthly_charges"),
            F.when(bucket20 < 11, "Month-to-month").when(bucket20 < 15, "One year")
            .otherwise("Two year").alias("contract"),
            F.col("c_mktsegment").alias("internet_service"),
            F.col("payment_method"),
            F.when(F.col("last_order") < F.date_sub(as_of, 365), 1).otherwise(0)
            .cast("int").alias("churn_value"),
            F.least(F.lit(100), F.floor(days_idle / 10)).cast("int").alias("churn_score"),
            F.round(F.col("c_acctbal") + 2000, 0).alias("cltv"),
        )
    )
