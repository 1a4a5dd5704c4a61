"""Synthetic customers with the reference generator's rules (survey §2.1).

One row per input key; every random draw is a keyed xxhash of (key, seed,
draw name), so the output depends only on the keys and the seed - not on
partitioning or retries.  The generator's numbers are not reproduced (its
NumPy stream cannot be), its rules are:

fixed values: ids ``%04d-CUSTM`` of key + 1; Count 1; Country 'United
States'; State 'California'; 50 cities ``City_1`` .. ``City_50`` uniform;
zip 90001..96162 as text; latitude U(32.5, 42); longitude U(-124.5, -114);
``Lat Long`` both at 4 decimals; Gender Male/Female; Senior Yes 16%;
Partner Yes/No; Dependents Yes 30%; Contract Month-to-month 55%, One year
22%, Two year 23%; Paperless Yes/No; Payment Method Electronic check,
Mailed check, Bank transfer (automatic), Credit card (automatic); Phone
Yes 90%; Internet DSL 35%, Fiber optic 45%, No 20%; Multiple Lines 'No
phone service' without phone, else Yes 45%; six add-ons 'No internet
service' without internet, else Yes 40%; tenure 1..72; monthly: fiber
N(95, 18) floored at 50, else N(50, 12) floored at 18, 2 decimals; total =
monthly x tenure x U(0.9, 1.1), 2 decimals, = monthly when tenure <= 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDONS = ("online_security", "online_backup", "device_protection", "tech_support",
          "streaming_tv", "streaming_movies")
PAYMENT = ("Electronic check", "Mailed check", "Bank transfer (automatic)",
           "Credit card (automatic)")
COLUMNS = ("customer_id", "count", "country", "state", "city", "zip_code", "lat_long",
           "latitude", "longitude", "gender", "senior_citizen", "partner", "dependents",
           "tenure_months", "phone_service", "multiple_lines", "internet_service",
           "online_security", "online_backup", "device_protection", "tech_support",
           "streaming_tv", "streaming_movies", "contract", "paperless_billing",
           "payment_method", "monthly_charges", "total_charges")


def _u(key: Column, seed: int, name: str) -> Column:
    h = F.xxhash64(key, F.lit(seed), F.lit(name))
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _choice(u: Column, values, probs=None) -> Column:
    probs = probs or [1.0 / len(values)] * len(values)
    out, acc = None, 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        out = F.when(u < acc, F.lit(v)) if out is None else out.when(u < acc, F.lit(v))
    return out.otherwise(F.lit(values[-1])) if out is not None else F.lit(values[-1])


def _normal(key: Column, seed: int, name: str) -> Column:
    """Box-Muller from two keyed uniforms."""
    u1, u2 = _u(key, seed, name + "1"), _u(key, seed, name + "2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def generate_customers(keys: DataFrame, key: str, seed: int = 123) -> DataFrame:
    """Synthetic customers, one per distinct ``key`` of ``keys``."""
    k = F.col(key)

    def u(name):
        return _u(k, seed, name)

    df = keys.select(k).distinct()
    df = (df.withColumn("customer_id", F.format_string("%04d-CUSTM", k + 1))
          .withColumn("count", F.lit(1))
          .withColumn("country", F.lit("United States"))
          .withColumn("state", F.lit("California"))
          .withColumn("city", F.concat(F.lit("City_"),
                                       (F.floor(u("city") * 50) + 1).cast("string")))
          .withColumn("zip_code", (F.lit(90001) + F.floor(u("zip") * 6162)).cast("int")
                      .cast("string"))
          .withColumn("latitude", F.lit(32.5) + u("lat") * 9.5)
          .withColumn("longitude", F.lit(-124.5) + u("lon") * 10.5)
          .withColumn("lat_long", F.format_string("%.4f, %.4f", "latitude", "longitude"))
          .withColumn("gender", _choice(u("gender"), ["Male", "Female"]))
          .withColumn("senior_citizen", _choice(u("senior"), ["Yes", "No"], [0.16, 0.84]))
          .withColumn("partner", _choice(u("partner"), ["Yes", "No"]))
          .withColumn("dependents", _choice(u("dependents"), ["Yes", "No"], [0.3, 0.7]))
          .withColumn("contract", _choice(u("contract"), ["Month-to-month", "One year",
                                                          "Two year"], [0.55, 0.22, 0.23]))
          .withColumn("paperless_billing", _choice(u("paperless"), ["Yes", "No"]))
          .withColumn("payment_method", _choice(u("payment"), list(PAYMENT)))
          .withColumn("phone_service", _choice(u("phone"), ["Yes", "No"], [0.9, 0.1]))
          .withColumn("internet_service", _choice(u("internet"), ["DSL", "Fiber optic", "No"],
                                                  [0.35, 0.45, 0.20]))
          .withColumn("multiple_lines", F.when(F.col("phone_service") == "No",
                                               "No phone service")
                      .otherwise(_choice(u("lines"), ["Yes", "No"], [0.45, 0.55]))))
    for c in ADDONS:
        df = df.withColumn(c, F.when(F.col("internet_service") == "No", "No internet service")
                           .otherwise(_choice(u(c), ["Yes", "No"], [0.4, 0.6])))
    fiber = F.col("internet_service") == "Fiber optic"
    z = _normal(k, seed, "monthly")
    monthly = F.when(fiber, F.greatest(F.lit(95.0) + 18 * z, F.lit(50.0))).otherwise(
        F.greatest(F.lit(50.0) + 12 * z, F.lit(18.0)))
    df = (df.withColumn("tenure_months", (F.floor(u("tenure") * 72) + 1).cast("int"))
          .withColumn("monthly_charges", F.round(monthly, 2)))
    total = F.round(F.col("monthly_charges") * F.col("tenure_months")
                    * (F.lit(0.9) + 0.2 * u("total")), 2)
    df = df.withColumn("total_charges", F.when(F.col("tenure_months") <= 1,
                                               F.col("monthly_charges")).otherwise(total))
    return df.select(*COLUMNS)
