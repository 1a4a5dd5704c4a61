"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Every statement starts from the same ``customer_360`` CTE as
``retentio.sources.mart``; the base tables are views pre-registered by the
checker.  Doubles are rounded the same way on both sides before hashing.
"""

from __future__ import annotations

from ..functions.columns import REFERENCE_PROBABILITY_SQL

MART_CTE = """
per_cust AS (
  SELECT o_custkey AS customer_id,
         min(CAST(o_orderdate AS DATE)) AS first_order,
         max(CAST(o_orderdate AS DATE)) AS last_order,
         sum(o_totalprice) AS spend
  FROM orders GROUP BY o_custkey
),
prio AS (
  SELECT customer_id, payment_method FROM (
    SELECT o_custkey AS customer_id, o_orderpriority AS payment_method,
           row_number() OVER (PARTITION BY o_custkey
                              ORDER BY count(*) DESC, o_orderpriority) AS rn
    FROM orders WHERE o_orderpriority IS NOT NULL
    GROUP BY o_custkey, o_orderpriority) t
  WHERE rn = 1
),
as_of AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
mart_base AS (
  SELECT p.customer_id, n.n_name AS city,
         CAST(floor(date_diff('day', p.first_order, p.last_order) / 30) AS INTEGER)
           AS tenure_months,
         CAST(round(p.spend * 100) AS BIGINT) AS spend_cents,
         CAST(greatest(floor(date_diff('day', p.first_order, p.last_order) / 30), 1)
              AS BIGINT) AS months,
         p.last_order, a.as_of, c.c_acctbal, c.c_mktsegment,
         pr.payment_method
  FROM per_cust p
  JOIN customer c ON p.customer_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN prio pr ON pr.customer_id = p.customer_id
  CROSS JOIN as_of a
),
customer_360 AS (
  SELECT customer_id, city, tenure_months,
         CASE WHEN customer_id % 97 = 0 THEN ''
              ELSE printf('%.2f', CAST(spend_cents AS DOUBLE) / 100) END AS total_charges_raw,
         CAST((2 * spend_cents + months) // (2 * months) AS DOUBLE) / 100 AS monthly_charges,
         CASE WHEN customer_id % 20 < 11 THEN 'Month-to-month'
              WHEN customer_id % 20 < 15 THEN 'One year' ELSE 'Two year' END AS contract,
         c_mktsegment AS internet_service,
         payment_method,
         CAST(CASE WHEN last_order < as_of - INTERVAL 365 DAY THEN 1 ELSE 0 END AS INTEGER)
           AS churn_value,
         CAST(least(100, floor(date_diff('day', last_order, as_of) / 10)) AS INTEGER)
           AS churn_score,
         round(c_acctbal + 2000, 0) AS cltv
  FROM mart_base
)"""

# total_charges parsed and filled, cities outside the top 20 -> 'Other'
CLEAN_CTE = MART_CTE + """,
parsed AS (
  SELECT * EXCLUDE (total_charges_raw),
         CASE WHEN isnan(TRY_CAST(trim(total_charges_raw) AS DOUBLE)) THEN NULL
              ELSE TRY_CAST(trim(total_charges_raw) AS DOUBLE) END AS total_charges
  FROM customer_360
),
top_city AS (
  SELECT city FROM (SELECT city, count(*) AS n FROM parsed WHERE city IS NOT NULL
                    GROUP BY city ORDER BY n DESC, city LIMIT 20) t
),
clean AS (
  SELECT customer_id,
         CASE WHEN city IN (SELECT city FROM top_city) THEN city ELSE 'Other' END AS city,
         tenure_months, monthly_charges, contract, internet_service, payment_method,
         churn_value, churn_score, cltv,
         coalesce(total_charges, monthly_charges * tenure_months) AS total_charges
  FROM parsed
)"""

TENURE_GROUP_SQL = """CASE WHEN tenure_months >= 0 AND tenure_months <= 12 THEN 'New Customer'
            WHEN tenure_months > 12 AND tenure_months <= 30 THEN 'New/Established Customer'
            WHEN tenure_months > 30 AND tenure_months <= 50 THEN 'Established/Veteran Customer'
            WHEN tenure_months > 50 THEN 'Veteran Customer' END"""

SCORE_BAND_SQL = """CASE WHEN churn_score >= 0 AND churn_score <= 25 THEN 'Less Probability of Churn'
            WHEN churn_score > 25 AND churn_score <= 50 THEN 'Less/Moderate Probability of Churn'
            WHEN churn_score > 50 AND churn_score <= 75 THEN 'Moderate/High Probability of Churn'
            WHEN churn_score > 75 AND churn_score <= 100 THEN 'High Probability of Churn' END"""

VALUE_BAND_SQL = """CASE WHEN cltv >= 0 AND cltv <= 3000 THEN 'Low Value'
            WHEN cltv > 3000 AND cltv <= 4000 THEN 'Low/Mid Value'
            WHEN cltv > 4000 AND cltv <= 5000 THEN 'Mid/High Value'
            WHEN cltv > 5000 THEN 'High Value' END"""

BINNED_CTE = CLEAN_CTE + f""",
binned AS (
  SELECT *, {TENURE_GROUP_SQL} AS tenure_group,
         {SCORE_BAND_SQL} AS churn_score_band,
         {VALUE_BAND_SQL} AS customer_value
  FROM clean
)"""

PROB_SQL = REFERENCE_PROBABILITY_SQL

SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


register("churn_by_tenure_group", f"""
WITH {BINNED_CTE}
SELECT tenure_group, CAST(count(*) AS BIGINT) AS customers,
       round(avg(churn_value), 6) AS churn_rate
FROM binned GROUP BY tenure_group
""")

register("customer_360", f"""
WITH {MART_CTE}
SELECT * FROM customer_360
""")


# ---------------------------------------------------------------- helpers
def union_all(parts):
    return "\nUNION ALL\n".join(parts)


def missing_sql(col: str, is_double: bool) -> str:
    return f"({col} IS NULL OR isnan({col}))" if is_double else f"({col} IS NULL)"


PARSED_TYPES = {  # column -> is DOUBLE, in the mart's column order
    "customer_id": False, "city": False, "tenure_months": False, "monthly_charges": True,
    "contract": False, "internet_service": False, "payment_method": False,
    "churn_value": False, "churn_score": False, "cltv": True, "total_charges": True,
}
CLEAN_NUMERIC = ("tenure_months", "monthly_charges", "total_charges", "cltv")
AGG_SQL = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "median": "median({c})",
           "std": "stddev_samp({c})", "sum": "sum({c})", "var": "var_samp({c})",
           "count": "count({c})", "nunique": "count(DISTINCT {c})"}


def agg_matrix_sql(cte: str, src: str, plan: dict, digits: int) -> str:
    funcs = []
    for fns in plan.values():
        for f in fns:
            if f not in funcs:
                funcs.append(f)
    parts = []
    for f in funcs:
        cols = []
        for c, fns in plan.items():
            e = (f"round(CAST({AGG_SQL[f].format(c=c)} AS DOUBLE), {digits})" if f in fns
                 else "CAST(NULL AS DOUBLE)")
            cols.append(f"{e} AS {c}")
        parts.append(f"SELECT '{f}' AS aggregate, {', '.join(cols)} FROM {src}")
    return f"WITH {cte}\n" + union_all(parts)


def hist_parts(p: str, src: str, col: str, n: int, hue: str | None) -> tuple[str, str]:
    """CTEs (names prefixed with ``p``) and the final SELECT of one histogram."""
    h = f"CAST({hue} AS VARCHAR)" if hue else "CAST(NULL AS VARCHAR)"
    nd = f"CAST({n} AS DOUBLE)"

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= {n} THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END)"

    hues = (f"(SELECT DISTINCT {h} AS h FROM {src})" if hue
            else "(SELECT CAST(NULL AS VARCHAR) AS h)")
    ctes = f"""{p}src AS (SELECT CAST({col} AS DOUBLE) AS v, {h} AS h FROM {src}
          WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
{p}rng AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
          FROM {p}src),
{p}par AS (SELECT lo, hi, (hi - lo) / {nd} AS step FROM {p}rng),
{p}k0 AS (SELECT v, h, lo, hi, step,
                CAST(floor((v - lo) * ({nd} / (hi - lo))) AS INTEGER) AS k FROM {p}src, {p}par),
{p}k1 AS (SELECT *, CASE WHEN k >= {n} THEN {n - 1} ELSE k END AS k1 FROM {p}k0),
{p}k2 AS (SELECT *, CASE WHEN v < {edge('k1')} THEN k1 - 1 ELSE k1 END AS k2 FROM {p}k1),
{p}k3 AS (SELECT *, CASE WHEN v >= {edge('k2 + 1')} AND k2 <> {n - 1} THEN k2 + 1
                        ELSE k2 END AS k3 FROM {p}k2),
{p}cnt AS (SELECT k3 + 1 AS bin, h, count(*) AS c FROM {p}k3 GROUP BY 1, 2),
{p}grid AS (SELECT CAST(g.b AS INTEGER) AS bin, hs.h, lo, hi, step
           FROM generate_series(1, {n}) g(b) CROSS JOIN {hues} hs CROSS JOIN {p}par)"""
    select = f"""SELECT {p}grid.h AS hue, {p}grid.bin,
       round({edge(f'{p}grid.bin - 1')}, 6) AS bin_lo,
       round({edge(f'{p}grid.bin')}, 6) AS bin_hi,
       CAST(coalesce({p}cnt.c, 0) AS BIGINT) AS count
FROM {p}grid LEFT JOIN {p}cnt ON {p}grid.bin = {p}cnt.bin
     AND {p}grid.h IS NOT DISTINCT FROM {p}cnt.h"""
    return ctes, select


def histogram_sql(cte: str, src: str, col: str, n: int, hue: str | None) -> str:
    ctes, select = hist_parts("h_", src, col, n, hue)
    return f"WITH {cte},\n{ctes}\n{select}"


# ---------------------------------------------------------------- cleaning
register("trim_to_double", f"""
WITH {CLEAN_CTE}
SELECT customer_id, total_charges FROM parsed""")

register("fill_total_charges", f"""
WITH {CLEAN_CTE}
SELECT customer_id, coalesce(total_charges, monthly_charges * tenure_months) AS total_charges
FROM parsed""")

register("null_counts", f"WITH {CLEAN_CTE}\n" + union_all([
    f"SELECT '{c}' AS \"column\", CAST(count_if({missing_sql(c, d)}) AS BIGINT) AS null_count"
    f" FROM parsed" for c, d in PARSED_TYPES.items()]))

register("null_mask", f"WITH {CLEAN_CTE}\nSELECT customer_id, " + ", ".join(
    f"{missing_sql(c, d)} AS {c}" for c, d in PARSED_TYPES.items() if c != "customer_id")
    + " FROM parsed")

register("replace_values", f"""
WITH {CLEAN_CTE}
SELECT customer_id, CASE WHEN contract IN ('One year', 'Two year') THEN 'Long term'
                         ELSE contract END AS contract FROM clean""")

register("filter_project", f"""
WITH {CLEAN_CTE}
SELECT customer_id, city, monthly_charges FROM clean
WHERE contract = 'Month-to-month' AND tenure_months >= 12""")

register("drop_columns", f"""
WITH {CLEAN_CTE}
SELECT * EXCLUDE (payment_method, city) FROM clean""")

register("drop_rows_by_key", f"""
WITH {CLEAN_CTE}
SELECT customer_id, churn_score FROM clean
WHERE customer_id NOT IN (SELECT customer_id FROM clean WHERE churn_score >= 90)""")

register("topk_other", f"""
WITH {MART_CTE},
top_city AS (SELECT city FROM customer_360 WHERE city IS NOT NULL GROUP BY city
             ORDER BY count(*) DESC, city LIMIT 20)
SELECT customer_id, CASE WHEN city IN (SELECT city FROM top_city) THEN city ELSE 'Other' END
       AS city FROM customer_360""")

register("topk_isin", f"""
WITH {CLEAN_CTE},
top2 AS (SELECT city FROM clean WHERE city IS NOT NULL GROUP BY city
         ORDER BY count(*) DESC, city LIMIT 20)
SELECT customer_id, city FROM clean WHERE city IN (SELECT city FROM top2)""")

register("filter_churned", f"""
WITH {CLEAN_CTE}
SELECT customer_id, tenure_months, cltv FROM clean
WHERE churn_value = 1 AND tenure_months >= 60""")

register("coerce_int_float", f"""
WITH {MART_CTE}
SELECT customer_id,
       TRY_CAST(trim(' ' || CAST(tenure_months AS VARCHAR)) AS INTEGER) AS tenure_int,
       CASE WHEN isnan(TRY_CAST(trim(total_charges_raw) AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(trim(total_charges_raw) AS DOUBLE) END AS charges_double,
       CASE WHEN regexp_full_match(trim(total_charges_raw), '[+-]?[0-9]+')
            THEN TRY_CAST(trim(total_charges_raw) AS INTEGER) END AS charges_int
FROM customer_360""")

register("clean_customers", f"""
WITH {CLEAN_CTE}
SELECT * FROM clean""")

# ---------------------------------------------------------------- profiles
register("agg_named", f"WITH {CLEAN_CTE}\nSELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in CLEAN_NUMERIC) + " FROM clean")

register("agg_list", agg_matrix_sql(
    CLEAN_CTE, "clean", {c: ["min", "max", "mean", "median", "std"] for c in CLEAN_NUMERIC}, 6))

register("agg_dict", agg_matrix_sql(
    CLEAN_CTE, "clean", {"tenure_months": ["min", "max"], "cltv": ["mean"],
                         "monthly_charges": ["median", "sum"], "city": ["nunique"]}, 4))

register("agg_callable", f"""
WITH {CLEAN_CTE}
SELECT CAST(max(monthly_charges) AS DOUBLE) AS monthly_charges,
       CAST(max(cltv) AS DOUBLE) AS cltv FROM clean""")

register("agg_callable_range", f"""
WITH {CLEAN_CTE}
SELECT CAST(max(monthly_charges) - min(monthly_charges) AS DOUBLE) AS monthly_charges,
       CAST(max(cltv) - min(cltv) AS DOUBLE) AS cltv FROM clean""")

register("value_counts", f"""
WITH {CLEAN_CTE}
SELECT city, count(*) AS count FROM clean WHERE city IS NOT NULL GROUP BY city""")

register("value_counts_many", f"WITH {BINNED_CTE}\n" + union_all([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM binned WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("contract", "internet_service", "payment_method", "tenure_group")]))

register("value_counts_lineitem", union_all([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")]))

register("mean_churn", f"""
WITH {CLEAN_CTE}
SELECT round(avg(churn_value), 6) AS churn_rate FROM clean""")

register("median_monthly", f"""
WITH {CLEAN_CTE}
SELECT round(median(monthly_charges), 6) AS median_monthly_charges FROM clean""")

register("median_cltv_longtenure", f"""
WITH {CLEAN_CTE}
SELECT round(median(cltv), 6) AS median_cltv, count(*) AS customers FROM clean
WHERE churn_value = 1 AND tenure_months >= 60""")

register("count_distinct", f"WITH {CLEAN_CTE}\n" + union_all([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM clean"
    for c in PARSED_TYPES]))

register("mode", f"WITH {CLEAN_CTE}\n" + union_all([
    f"SELECT '{c}' AS \"column\", (SELECT CAST({c} AS VARCHAR) FROM clean WHERE {c} IS NOT NULL"
    f" GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"
    for c in ("city", "contract", "internet_service", "payment_method", "tenure_months")]))

register("median_where", f"""
WITH {CLEAN_CTE}
SELECT internet_service, round(median(monthly_charges), 6) AS median_monthly_charges
FROM clean GROUP BY internet_service""")


def describe_sql(cte: str, src: str, cols, digits: int) -> str:
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"),
             ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)"),
             ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
             ("75%", "quantile_cont({c}, 0.75)"), ("max", "CAST(max({c}) AS DOUBLE)")]
    head = f"WITH {cte}\n" if cte else ""
    return head + union_all([
        f"SELECT '{s}' AS statistic, " + ", ".join(
            f"round(CAST({e.format(c=f'CAST({c} AS DOUBLE)')} AS DOUBLE), {digits}) AS {c}"
            for c in cols) + f" FROM {src}" for s, e in stats])


register("describe", describe_sql(CLEAN_CTE, "clean", CLEAN_NUMERIC, 6))
register("describe_lineitem", describe_sql(
    "", "lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 4))
register("describe_lineitem_refine", SQL["describe_lineitem"])

CLEAN_DTYPES = [("customer_id", "bigint"), ("city", "string"), ("tenure_months", "int"),
                ("monthly_charges", "double"), ("contract", "string"),
                ("internet_service", "string"), ("payment_method", "string"),
                ("churn_value", "int"), ("churn_score", "int"), ("cltv", "double"),
                ("total_charges", "double")]
register("info", f"WITH {CLEAN_CTE}\n" + union_all([
    f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{t}' AS dtype, "
    f"count({c}) AS non_null FROM clean" for i, (c, t) in enumerate(CLEAN_DTYPES)]))

register("histogram", histogram_sql(CLEAN_CTE, "clean", "monthly_charges", 20, None))
register("histogram_hue", histogram_sql(CLEAN_CTE, "clean", "tenure_months", 20, "churn_value"))

register("histogram_hue_null", histogram_sql(CLEAN_CTE + """,
planned AS (SELECT *, CASE WHEN customer_id % 7 = 0 THEN NULL ELSE contract END AS plan FROM clean)""",
                                             "planned", "monthly_charges", 20, "plan"))
register("histogram_lineitem", histogram_sql(
    "li AS (SELECT * FROM lineitem)", "li", "l_extendedprice", 20, "l_returnflag"))

register("count_by", f"""
WITH {CLEAN_CTE}
SELECT coalesce(CAST(contract AS VARCHAR), 'nan') AS category,
       coalesce(CAST(churn_value AS VARCHAR), 'nan') AS hue, count(*) AS count
FROM clean GROUP BY 1, 2""")

_CORR_COLS = ("tenure_months", "monthly_charges", "churn_value", "churn_score", "cltv",
              "total_charges")
register("corr_matrix", f"WITH {CLEAN_CTE}\n" + union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL "
    f"ELSE corr({a}, {b}) END, 6) AS r FROM clean" for a in _CORR_COLS for b in _CORR_COLS]))


# ---------------------------------------------------------------- binning
register("bin_tenure", f"""
WITH {BINNED_CTE}
SELECT customer_id, tenure_months, tenure_group FROM binned""")

register("bin_score", f"""
WITH {BINNED_CTE}
SELECT customer_id, churn_score, churn_score_band FROM binned""")

register("bin_value", f"""
WITH {BINNED_CTE}
SELECT customer_id, cltv, customer_value FROM binned""")

register("bin_all", f"""
WITH {BINNED_CTE}
SELECT customer_id, tenure_group, churn_score_band, customer_value FROM binned""")

register("bin_tenure_open", f"""
WITH {MART_CTE}
SELECT customer_id, CAST(tenure_months AS DOUBLE) AS tenure_months,
       {TENURE_GROUP_SQL} AS tenure_group FROM customer_360""")

register("bin_tenure_open_text", f"""
WITH {MART_CTE},
t AS (SELECT customer_id, CASE customer_id % 6 WHEN 1 THEN tenure_months + 0.5 WHEN 2 THEN -0.5
                          WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE tenure_months END::DOUBLE
             AS tenure_months FROM customer_360)
SELECT customer_id, tenure_months, {TENURE_GROUP_SQL} AS tenure_group FROM t""")

register("bin_equal_width", f"""
WITH {CLEAN_CTE},
r AS (SELECT min(monthly_charges) AS mn, max(monthly_charges) AS mx FROM clean),
b0 AS (SELECT customer_id, monthly_charges AS v, mn, mx,
              (mx - mn) / CAST(4 AS DOUBLE) AS step FROM clean, r),
b1 AS (SELECT *, least(greatest(CAST(ceil((v - mn) / step) AS INTEGER), 1), 4) AS k FROM b0),
b2 AS (SELECT *, k
         - CASE WHEN k > 1 AND v <= (CASE WHEN k - 1 >= 4 THEN mx ELSE mn + step * (k - 1) END)
                THEN 1 ELSE 0 END
         + CASE WHEN k < 4 AND v > (CASE WHEN k >= 4 THEN mx ELSE mn + step * k END)
                THEN 1 ELSE 0 END AS k2 FROM b1)
SELECT customer_id, v AS monthly_charges,
       CASE WHEN mx = mn THEN 'Q2' WHEN v BETWEEN mn AND mx
            THEN (['Q1', 'Q2', 'Q3', 'Q4'])[k2] END AS charge_band FROM b2""")

# ---------------------------------------------------------------- chi-square
SCAN_FEATURES = ("city", "contract", "internet_service", "payment_method", "tenure_group",
                 "churn_score_band", "customer_value")


def chi2_cte(features, label="churn_value", src="binned") -> str:
    longs = union_all([
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, "
        f"CAST({label} AS VARCHAR) AS lab FROM {src} WHERE {label} IS NOT NULL" for f in features])
    return f"""{BINNED_CTE},
c_long AS ({longs}),
c_cnt AS (SELECT feature, value, lab, count(*) AS observed FROM c_long
          WHERE value IS NOT NULL GROUP BY 1, 2, 3),
c_labs AS (SELECT DISTINCT CAST({label} AS VARCHAR) AS lab FROM {src}
           WHERE {label} IS NOT NULL),
c_grid AS (SELECT DISTINCT feature, value FROM c_cnt),
c_cells AS (SELECT g.feature, g.value, l.lab, coalesce(c.observed, 0) AS observed
            FROM c_grid g CROSS JOIN c_labs l
            LEFT JOIN c_cnt c ON c.feature = g.feature AND c.value = g.value AND c.lab = l.lab),
c_e AS (SELECT *, sum(observed) OVER (PARTITION BY feature, value) AS rt,
               sum(observed) OVER (PARTITION BY feature, lab) AS ct,
               sum(observed) OVER (PARTITION BY feature) AS n FROM c_cells),
c_e2 AS (SELECT *, CAST(rt * ct AS DOUBLE) / n AS expected FROM c_e),
c_shape AS (SELECT feature, CAST(count(DISTINCT value) AS INTEGER) AS n_rows,
                   CAST(count(DISTINCT lab) AS INTEGER) AS n_cols FROM c_cells GROUP BY feature),
c_t AS (SELECT c_e2.*, n_rows, n_cols, (n_rows - 1) * (n_cols - 1) AS dof,
               CASE WHEN (n_rows - 1) * (n_cols - 1) = 1
                    THEN observed + 0.5 * sign(expected - observed)
                    ELSE CAST(observed AS DOUBLE) END AS oadj
        FROM c_e2 JOIN c_shape USING (feature)),
c_per AS (SELECT feature, CAST(first(n) AS BIGINT) AS n, first(n_rows) AS n_rows,
                 first(n_cols) AS n_cols, first(dof) AS dof, count(*) AS cells,
                 CAST(count_if(expected < 5) AS BIGINT) AS cells_lt5,
                 sum((oadj - expected) * (oadj - expected) / expected) AS statistic
          FROM c_t GROUP BY feature)"""


DOCLAB_CTE = """doclab AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
                 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

register("chi2_scan_documents", f"""
WITH {DOCLAB_CTE},
{chi2_cte(["lang", "source"], label="toxic", src="doclab")}
SELECT feature, n, dof, round(statistic, 6) AS statistic,
       round(CASE WHEN least(n_rows, n_cols) - 1 > 0 AND n > 0
                  THEN sqrt(statistic / (n * (least(n_rows, n_cols) - 1))) END, 6) AS cramers_v
FROM c_per""")

def _gamma_p(a: str, x: str, terms: int) -> str:
    """Regularised lower incomplete gamma function as its power series."""
    return (f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > {terms * 0.6} THEN 1.0 ELSE "
            f"list_sum(list_transform(range(0, {terms}), lambda k: exp(-({x}) + ({a} + k) * ln({x}) "
            f"- lgamma({a} + k + 1)))) END)")


def chi2_tests_sql(head: str, features, label: str, src: str, power: bool) -> str:
    """The full tests: p by the series; the critical value by bisection and the
    power as a Poisson mixture when ``power`` is asked."""
    cte = f"""WITH RECURSIVE {head}
{chi2_cte(features, label=label, src=src)},
st AS (SELECT c_per.*, cells_lt5 / CAST(cells AS DOUBLE) <= 0.2 AS met,
              CASE WHEN least(n_rows, n_cols) - 1 > 0 AND n > 0
                   THEN sqrt(statistic / (n * (least(n_rows, n_cols) - 1))) END AS v FROM c_per),
pv AS (SELECT *, CASE WHEN met AND dof > 0
                 THEN 1.0 - {_gamma_p('dof / 2.0', '(statistic / 2.0)', 4000)} END AS p FROM st),
j AS (SELECT *, coalesce(p <= 0.05, false) AS reject FROM pv)"""
    verdict = ("CASE WHEN NOT met THEN 'Assumption Not Met' WHEN reject "
               "THEN 'Reject Null Hypothesis (H0)' "
               "ELSE 'Fail to Reject the Null Hypothesis (H0)' END AS verdict")
    strength = ("CASE WHEN met AND reject THEN CASE WHEN v <= 0.10 THEN 'Weak Association' "
                "WHEN v <= 0.30 THEN 'Moderate Association' WHEN v <= 0.50 "
                "THEN 'Strong Association' ELSE 'Very Strong Association' END END AS strength")
    base = "feature, dof, round(statistic, 6) AS statistic, round(p, 8) AS p_value"
    if not power:
        return f"{cte}\nSELECT {base}, {verdict}, {strength} FROM j"
    return f"""{cte},
crit AS (SELECT dof, 0.0::DOUBLE AS lo, (dof + 20 * sqrt(dof) + 50)::DOUBLE AS hi, 0 AS i
         FROM (SELECT DISTINCT dof FROM j WHERE dof > 0)
         UNION ALL
         SELECT dof, CASE WHEN {_gamma_p('dof / 2.0', '((lo + hi) / 4.0)', 600)} < 0.95
                          THEN (lo + hi) / 2 ELSE lo END,
                CASE WHEN {_gamma_p('dof / 2.0', '((lo + hi) / 4.0)', 600)} < 0.95
                     THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM crit WHERE i < 60),
mix AS (SELECT feature, n * v * v / 2.0 AS half, (lo + hi) / 4.0 AS x, dof, unnest(range(0, 4000)) AS m
        FROM j JOIN crit USING (dof) WHERE i = 60 AND met AND dof > 0),
pw AS (SELECT feature, sum(exp(-half + m * ln(half) - lgamma(m + 1))
              * (1.0 - {_gamma_p('(dof / 2.0 + m)', 'x', 200)})) AS power
       FROM mix WHERE abs(m - half) <= 40 + 12 * sqrt(half) GROUP BY feature)
SELECT {base}, round(v, 6) AS cramers_v, round(power, 6) AS power, {verdict}, {strength},
       round(CASE WHEN met AND reject THEN 1 - power END, 6) AS type_ii_error
FROM j LEFT JOIN pw USING (feature)"""


register("chi2_tests_documents", chi2_tests_sql(DOCLAB_CTE + ",", ["lang", "source"], "quality", "doclab", False))
register("chi2_tests", chi2_tests_sql(
    "", ["city", "contract", "internet_service", "payment_method", "tenure_group",
                 "churn_score_band", "customer_value"], "churn_value", "binned", True))

register("contingency", f"""
WITH {chi2_cte(["contract"])}
SELECT value AS contract, lab AS churn_value, CAST(observed AS BIGINT) AS observed
FROM c_cells""")

register("chi2_expected", f"""
WITH {chi2_cte(["contract"])}
SELECT value AS contract, lab AS churn_value, CAST(observed AS BIGINT) AS observed,
       round(expected, 6) AS expected FROM c_e2""")

register("chi2_assumption", f"""
WITH {chi2_cte(SCAN_FEATURES)}
SELECT feature, cells, cells_lt5, round(CAST(cells_lt5 AS DOUBLE) / cells, 6) AS share_lt5,
       CAST(cells_lt5 AS DOUBLE) / cells <= 0.2 AS assumption_met FROM c_per""")

register("chi2_scan", f"""
WITH {chi2_cte(SCAN_FEATURES)}
SELECT feature, n, dof, round(statistic, 6) AS statistic,
       round(CASE WHEN least(n_rows, n_cols) - 1 > 0 AND n > 0
                  THEN sqrt(statistic / (n * (least(n_rows, n_cols) - 1))) END, 6) AS cramers_v
FROM c_per""")

# ---------------------------------------------------------------- decision
SCORED_CTE = BINNED_CTE + f""",
scored AS (SELECT *, {PROB_SQL} AS churn_probability FROM binned)"""

PROFIT_SQL = f"""{SCORED_CTE},
pv AS (SELECT median(cltv) AS value FROM customer_360),
grid AS (SELECT CAST(i AS DOUBLE) / 1000 AS threshold FROM generate_series(50, 950) g(i)),
cm AS (SELECT threshold,
              count_if(churn_value = 1 AND churn_probability > threshold) AS tp,
              count_if(churn_value = 0 AND churn_probability > threshold) AS fp,
              count_if(churn_value = 1 AND NOT (churn_probability > threshold)) AS fn,
              count_if(churn_value = 0 AND NOT (churn_probability > threshold)) AS tn
       FROM grid CROSS JOIN scored GROUP BY threshold),
curve AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
                 CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
                 round(tp * (value * CAST(0.8 AS DOUBLE) - CAST(100 AS DOUBLE))
                       - fp * CAST(100 AS DOUBLE) - fn * value, 4) AS profit
          FROM cm, pv)"""

register("profit_curve", f"WITH {PROFIT_SQL}\nSELECT * FROM curve")

register("profit_threshold", f"""
WITH {PROFIT_SQL}
SELECT threshold, profit AS best_profit FROM curve ORDER BY profit DESC, threshold LIMIT 1""")

CONFUSION_SQL = """SELECT CAST(count_if(churn_value = 0 AND NOT pred) AS BIGINT) AS tn,
       CAST(count_if(churn_value = 0 AND pred) AS BIGINT) AS fp,
       CAST(count_if(churn_value = 1 AND NOT pred) AS BIGINT) AS fn,
       CAST(count_if(churn_value = 1 AND pred) AS BIGINT) AS tp
FROM (SELECT churn_value, churn_probability > 0.5 AS pred FROM scored) x"""

register("confusion", f"WITH {SCORED_CTE}\n{CONFUSION_SQL}")

AUC_SQL = """auc_s AS (SELECT churn_probability AS p, sum(churn_value) AS pos,
                  sum(1 - churn_value) AS neg FROM scored GROUP BY 1),
auc_c AS (SELECT p, pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED
                 PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM auc_s),
auc AS (SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc
        FROM auc_c)"""

register("roc_auc", f"WITH {SCORED_CTE},\n{AUC_SQL}\nSELECT * FROM auc")


def _sdiv(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


register("eval_metrics", f"""
WITH {SCORED_CTE},
{AUC_SQL},
cm AS ({CONFUSION_SQL}),
pr AS (SELECT *, {_sdiv('tp', 'tp + fn')} AS recall, {_sdiv('tp', 'tp + fp')} AS precision
       FROM cm)
SELECT round(recall, 6) AS recall, round(precision, 6) AS precision,
       round({_sdiv('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
       round({_sdiv('2 * precision * recall', 'precision + recall')}, 6) AS f1, roc_auc
FROM pr, auc""")

register("score", f"""
WITH {SCORED_CTE}
SELECT customer_id, churn_probability,
       CAST(churn_probability >= 0.5 AS INTEGER) AS intervention_flag FROM scored""")

register("top_n_scored", f"""
WITH {SCORED_CTE}
SELECT customer_id, churn_probability,
       CAST(churn_probability >= 0.5 AS INTEGER) AS intervention_flag FROM scored
ORDER BY churn_probability DESC, customer_id LIMIT 100""")

register("rank_scored", f"""
WITH {SCORED_CTE}
SELECT customer_id, churn_probability FROM scored""")

ASSIGN_SQL = f"""{SCORED_CTE},
assigned AS (
  SELECT *, CASE (('0x' || substr(md5(concat_ws('|', CAST(customer_id AS VARCHAR), '123')),
                                  1, 8))::BIGINT % 3)
              WHEN 0 THEN 'A (Control)' WHEN 1 THEN 'B (Price Offer)'
              ELSE 'C (Service Offer)' END AS "group"
  FROM scored WHERE churn_probability >= 0.5 AND contract = 'Month-to-month'),
assigned2 AS (
  SELECT *, CASE "group" WHEN 'A (Control)' THEN 'None (Control)'
                         WHEN 'B (Price Offer)' THEN '10% Off 1-Year Contract'
                         ELSE '6 Months Free Tech Support' END AS intervention_details
  FROM assigned)"""

register("abc_assign", f"""
WITH {ASSIGN_SQL}
SELECT customer_id, "group", intervention_details FROM assigned2""")

register("group_summary", f"""
WITH {ASSIGN_SQL}
SELECT "group", count(*) AS customer_count FROM assigned2 GROUP BY 1""")

register("abc_readout", f"""
WITH {ASSIGN_SQL},
per AS (SELECT "group", count(*) AS customers, CAST(sum(churn_value) AS BIGINT) AS events
        FROM assigned2 GROUP BY 1),
ctl AS (SELECT customers AS c_n, events AS c_e FROM per WHERE "group" = 'A (Control)'),
j AS (SELECT *, CAST(events AS DOUBLE) / customers AS rate,
             CAST(c_e AS DOUBLE) / c_n AS c_rate,
             CAST(events + c_e AS DOUBLE) / (customers + c_n) AS pooled FROM per, ctl),
k AS (SELECT *, sqrt(pooled * (1 - pooled) * (1.0 / customers + 1.0 / c_n)) AS se FROM j)
SELECT "group", customers, events, round(rate, 6) AS rate, round(c_rate - rate, 6) AS uplift,
       round(CASE WHEN "group" <> 'A (Control)' AND se > 0 THEN (c_rate - rate) / se END, 6)
         AS z,
       round(CASE WHEN "group" <> 'A (Control)'
             THEN ((c_rate - rate) * v - 100.0::DOUBLE) * customers END, 4) AS profit,
       round(CASE WHEN "group" <> 'A (Control)' THEN (c_rate - rate) * v - 100.0::DOUBLE END, 6)
         AS profit_per_customer,
       round(CASE WHEN "group" <> 'A (Control)'
             THEN ((c_rate - rate) * v - 100.0::DOUBLE) / 100.0::DOUBLE END, 6) AS roi
FROM k, (SELECT CAST(median(cltv) AS DOUBLE) AS v FROM customer_360) m""")

# ---------------------------------------------------------------- imputation
register("impute_conditional", f"""
WITH {CLEAN_CTE},
inc AS (
  SELECT customer_id,
         CASE WHEN customer_id % 19 = 0 THEN NULL ELSE city END AS city,
         CASE WHEN customer_id % 23 = 0 THEN NULL ELSE contract END AS contract,
         CASE WHEN customer_id % 13 = 0 THEN NULL ELSE internet_service END AS internet_service,
         CASE WHEN customer_id % 7 = 0 THEN NULL ELSE payment_method END AS payment_method,
         CASE WHEN customer_id % 17 = 0 THEN NULL ELSE tenure_months END AS tenure_months,
         CASE WHEN customer_id % 11 = 0 THEN NULL ELSE monthly_charges END AS monthly_charges,
         CASE WHEN customer_id % 11 = 0 OR customer_id % 17 = 0 THEN NULL
              ELSE total_charges END AS total_charges
  FROM clean),
gm AS (SELECT
  (SELECT city FROM clean WHERE city IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    AS g_city,
  (SELECT contract FROM clean WHERE contract IS NOT NULL GROUP BY 1
   ORDER BY count(*) DESC, 1 LIMIT 1) AS g_contract,
  (SELECT internet_service FROM clean WHERE internet_service IS NOT NULL GROUP BY 1
   ORDER BY count(*) DESC, 1 LIMIT 1) AS g_internet,
  (SELECT payment_method FROM clean WHERE payment_method IS NOT NULL GROUP BY 1
   ORDER BY count(*) DESC, 1 LIMIT 1) AS g_payment,
  (SELECT CAST(floor(median(tenure_months)) AS INTEGER) FROM clean) AS g_tenure,
  (SELECT median(CAST(round(monthly_charges * 100) AS BIGINT)) FROM clean) AS g_med_c),
cm AS (SELECT internet_service, payment_method AS m_pay FROM (
         SELECT internet_service, payment_method,
                row_number() OVER (PARTITION BY internet_service
                                   ORDER BY count(*) DESC, payment_method) AS rn
         FROM clean WHERE payment_method IS NOT NULL GROUP BY 1, 2) t WHERE rn = 1),
mm AS (SELECT internet_service, median(CAST(round(monthly_charges * 100) AS BIGINT)) AS med_c
       FROM clean WHERE monthly_charges IS NOT NULL GROUP BY 1),
s1 AS (SELECT customer_id, coalesce(city, g_city) AS city,
              coalesce(contract, g_contract) AS contract,
              coalesce(internet_service, g_internet) AS internet_service,
              payment_method, coalesce(tenure_months, g_tenure) AS tenure_months,
              monthly_charges, total_charges, g_payment, g_med_c
       FROM inc, gm),
s2 AS (SELECT s1.*, coalesce(s1.payment_method, cm.m_pay, g_payment) AS pay2,
              coalesce(s1.monthly_charges,
                       round_even(coalesce(mm.med_c, g_med_c), 0) / 100) AS monthly2
       FROM s1 LEFT JOIN cm ON s1.internet_service = cm.internet_service
       LEFT JOIN mm ON s1.internet_service = mm.internet_service)
SELECT customer_id, city, contract, internet_service, pay2 AS payment_method, tenure_months,
       monthly2 AS monthly_charges,
       coalesce(total_charges, round(monthly2 * tenure_months, 2)) AS total_charges
FROM s2""")


# ---------------------------------------------------------------- ML
def md5_unit_sql(key: str, seed) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), 1, 8))"
            f"::BIGINT AS DOUBLE) / 4294967296")


register("split", f"""
WITH {CLEAN_CTE}
SELECT customer_id, CASE WHEN {md5_unit_sql('customer_id', 123)} < 0.2 THEN 'test'
                         ELSE 'train' END AS split FROM clean""")

register("stratified_folds", f"""
WITH {CLEAN_CTE},
h AS (SELECT customer_id, churn_value,
             ('0x' || substr(md5(concat_ws('|', CAST(customer_id AS VARCHAR), 'fold123')),
                             1, 12))::BIGINT AS hv FROM clean)
SELECT customer_id, churn_value,
       CAST((row_number() OVER (PARTITION BY churn_value ORDER BY hv, customer_id) - 1) % 5
            AS INTEGER) AS fold
FROM h""")

_ROLE_COLS = [("city", "string"), ("monthly_charges", "double"), ("contract", "string"),
              ("internet_service", "string"), ("payment_method", "string"),
              ("tenure_group", "string"), ("tenure_months", "int"),
              ("total_charges", "double"), ("churn_score", "int")]
register("select_features", f"WITH {BINNED_CTE},\nroles AS (" + union_all([
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct FROM binned"
    for c, t in _ROLE_COLS]) + """)
SELECT "column", dtype, n_distinct,
       CASE WHEN (dtype IN ('string', 'boolean') AND n_distinct <= 5) OR lower("column") = 'city'
            THEN 'one_hot'
            WHEN dtype IN ('int', 'bigint', 'double', 'float', 'smallint', 'tinyint')
                 AND n_distinct > 5 THEN 'scale'
            ELSE 'passthrough' END AS role
FROM roles""")

register("scale", f"""
WITH {CLEAN_CTE},
tr AS (SELECT * FROM clean WHERE {md5_unit_sql('customer_id', 123)} >= 0.2),
st AS (SELECT avg(monthly_charges) AS m1, stddev_pop(monthly_charges) AS s1,
              avg(CAST(tenure_months AS DOUBLE)) AS m2,
              stddev_pop(CAST(tenure_months AS DOUBLE)) AS s2 FROM tr)
SELECT customer_id,
       round((monthly_charges - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END, 6)
         AS monthly_scaled,
       round((CAST(tenure_months AS DOUBLE) - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1.0 END, 6)
         AS tenure_scaled
FROM clean, st""")

_NB_COLUMNS = ("monthly_charges", "tenure_months", "cltv")


def _nb_ll(c: int) -> str:
    terms = " + ".join(f"ln(2 * pi() * (c{c}.v_{x} + added)) + (d.{x} - c{c}.m_{x}) ** 2 / (c{c}.v_{x} + added)"
                       for x in _NB_COLUMNS)
    return f"round(ln(c{c}.n / total.n) - 0.5 * ({terms}), 4) AS ll_{c}"


register("gaussian_nb", f"""
WITH {CLEAN_CTE},
d AS (SELECT customer_id, churn_value, {", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _NB_COLUMNS)} FROM clean),
tr AS (SELECT * FROM d WHERE {md5_unit_sql('customer_id', 123)} >= 0.2),
cls AS (SELECT churn_value AS y, CAST(count(*) AS DOUBLE) AS n,
               {", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in _NB_COLUMNS)}
        FROM tr GROUP BY churn_value),
c0 AS (SELECT * FROM cls WHERE y = 0), c1 AS (SELECT * FROM cls WHERE y = 1),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest({", ".join(f"var_pop({x})" for x in _NB_COLUMNS)}) AS top FROM tr),
s AS (SELECT smoothing, share * top AS added
      FROM (VALUES ('1e-09', 1e-9), ('1e-07', 1e-7), ('1e-05', 1e-5), ('1e-03', 1e-3)) AS t(smoothing, share), total)
SELECT s.smoothing, d.customer_id, {_nb_ll(0)}, {_nb_ll(1)} FROM d, s, c0, c1, total""")

_VOTE_MODELS = f"""{SCORED_CTE},
vm AS (SELECT customer_id, churn_value AS label, churn_probability AS m_a,
              round(1.0 / (1.0 + exp(-(CAST(-1.0 AS DOUBLE) + CAST(0.03 AS DOUBLE) * churn_score
                    - CAST(0.01 AS DOUBLE) * tenure_months))), 6) AS m_b,
              round(churn_score / CAST(100.0 AS DOUBLE), 6) AS m_c FROM scored)"""


def _vote_sql() -> str:
    import itertools
    ws = [(1, 1, 1)] + [w for w in itertools.product((1, 2, 3), repeat=3) if len(set(w)) > 1]
    parts = []
    for w in ws:
        p = (f"(CAST({w[0]} AS DOUBLE) * m_a + CAST({w[1]} AS DOUBLE) * m_b "
             f"+ CAST({w[2]} AS DOUBLE) * m_c) / CAST({sum(w)} AS DOUBLE)")
        parts.append(
            f"SELECT '{w[0]},{w[1]},{w[2]}' AS weights, "
            f"CAST(count_if(label = 1 AND {p} > 0.5) AS DOUBLE) AS tp, "
            f"CAST(count_if(label = 0 AND {p} > 0.5) AS DOUBLE) AS fp, "
            f"CAST(count_if(label = 1 AND NOT ({p} > 0.5)) AS DOUBLE) AS fn, "
            f"CAST(count_if(label = 0 AND NOT ({p} > 0.5)) AS DOUBLE) AS tn FROM vm")
    return union_all(parts)


register("soft_vote", f"""
WITH {_VOTE_MODELS},
c AS ({_vote_sql()}),
m AS (SELECT weights, {_sdiv('tp', 'tp + fn')} AS recall, {_sdiv('tp', 'tp + fp')} AS precision,
             {_sdiv('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM c),
f AS (SELECT weights, round(recall, 6) AS recall, round(precision, 6) AS precision,
             round(accuracy, 6) AS accuracy,
             round({_sdiv('2 * precision * recall', 'precision + recall')}, 6) AS f1 FROM m)
SELECT *, CAST(row_number() OVER (ORDER BY recall DESC, f1 DESC, weights) AS INTEGER) AS rank
FROM f""")


def knn_sql(k: int, weights: str, p: int) -> str:
    dist = ("sqrt(sum((CAST(q.x AS DOUBLE) - CAST(r.x AS DOUBLE)) "
            "* (CAST(q.x AS DOUBLE) - CAST(r.x AS DOUBLE))))" if p == 2
            else "sum(abs(CAST(q.x AS DOUBLE) - CAST(r.x AS DOUBLE)))")
    score = ("sum(CASE WHEN rlabel = 1 THEN 1.0 ELSE 0.0 END) / count(*)" if weights == "uniform"
             else "sum(w * CASE WHEN rlabel = 1 THEN 1.0 ELSE 0.0 END) / sum(w)")
    return f"""
WITH tr AS (SELECT vec_id, embedding, label FROM embeddings
            WHERE {md5_unit_sql('vec_id', 123)} >= 0.2),
te AS (SELECT vec_id, embedding FROM embeddings WHERE {md5_unit_sql('vec_id', 123)} < 0.2),
qe AS (SELECT vec_id AS qid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
       FROM te),
re AS (SELECT vec_id AS rid, label AS rlabel, unnest(embedding) AS x,
              generate_subscripts(embedding, 1) AS i FROM tr),
d AS (SELECT q.qid, r.rid, r.rlabel, {dist} AS dist
      FROM qe q JOIN re r ON q.i = r.i GROUP BY q.qid, r.rid, r.rlabel),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rn FROM d),
top AS (SELECT *, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS has0
        FROM nn WHERE rn <= {k}),
tw AS (SELECT *, CASE WHEN has0 = 1 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END)
                      ELSE 1.0 / dist END AS w FROM top)
SELECT qid AS vec_id, round({score}, 6) AS knn_score FROM tw GROUP BY qid"""


register("knn_score", knn_sql(3, "uniform", 2))
register("knn_score_distance", knn_sql(4, "distance", 1))


# ---------------------------------------------------------------- sources / sets
register("src_table", "SELECT * FROM customer")
register("src_table_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date "
                            "FROM orders")
register("sink_scored", f"""
WITH {SCORED_CTE}
SELECT customer_id, churn_probability, 1 AS intervention_flag FROM scored
WHERE churn_probability >= 0.5""")
register("head", f"WITH {CLEAN_CTE}\nSELECT * FROM clean ORDER BY customer_id LIMIT 5")
register("attach_predictions", f"""
WITH {_VOTE_MODELS}
SELECT 'm_a' AS model, customer_id, label AS churn_value, m_a AS proba FROM vm
UNION ALL SELECT 'm_b', customer_id, label, m_b FROM vm
UNION ALL SELECT 'm_c', customer_id, label, m_c FROM vm""")
register("profit_sorted", f"WITH {PROFIT_SQL}\nSELECT threshold, profit FROM curve")

register("kde", f"""
WITH {CLEAN_CTE},
src AS (SELECT monthly_charges AS v FROM clean
        WHERE monthly_charges IS NOT NULL AND NOT isnan(monthly_charges)),
st AS (SELECT count(v) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM src),
bw AS (SELECT n, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, mn, mx FROM st),
lim AS (SELECT n, h, mn - 3.0 * h AS lo, mx + 3.0 * h AS hi FROM bw),
grid AS (SELECT CAST(i AS INTEGER) AS point,
                CASE WHEN i = 199 THEN hi ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / 199) END
                  AS x, n, h FROM generate_series(0, 199) g(i), lim)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 12)
         AS density
FROM grid, src GROUP BY point, x, n, h""")

register("chi2_stat", f"""
WITH {chi2_cte(["contract"], src="clean")}
SELECT n, dof, round(statistic, 6) AS statistic,
       round(CASE WHEN least(n_rows, n_cols) - 1 > 0 AND n > 0
                  THEN sqrt(statistic / (n * (least(n_rows, n_cols) - 1))) END, 6) AS cramers_v
FROM c_per""")


def _onehot_part(col: str) -> str:
    return (f"list_transform((SELECT list(DISTINCT {col} ORDER BY {col}) FROM oh_train), "
            f"lambda x: CASE WHEN b.{col} = x THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")


register("one_hot", f"""
WITH {BINNED_CTE},
oh_train AS (SELECT * FROM binned WHERE {md5_unit_sql('customer_id', 123)} >= 0.2)
SELECT b.customer_id,
       list_concat(list_concat({_onehot_part('contract')}, {_onehot_part('internet_service')}),
                   {_onehot_part('tenure_group')}) AS one_hot
FROM binned b""")

register("union_results", f"""
WITH {_VOTE_MODELS},
{AUC_SQL},
cm AS ({CONFUSION_SQL}),
pr AS (SELECT *, {_sdiv('tp', 'tp + fn')} AS recall, {_sdiv('tp', 'tp + fp')} AS precision
       FROM cm),
em AS (SELECT round(recall, 6) AS recall, round(precision, 6) AS precision,
              round({_sdiv('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
              round({_sdiv('2 * precision * recall', 'precision + recall')}, 6) AS f1, roc_auc
       FROM pr, auc),
vc AS ({_vote_sql()}),
vm1 AS (SELECT weights, {_sdiv('tp', 'tp + fn')} AS recall, {_sdiv('tp', 'tp + fp')} AS precision,
               {_sdiv('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM vc),
vf AS (SELECT weights, round(recall, 6) AS recall, round(precision, 6) AS precision,
              round(accuracy, 6) AS accuracy,
              round({_sdiv('2 * precision * recall', 'precision + recall')}, 6) AS f1 FROM vm1),
vr AS (SELECT *, row_number() OVER (ORDER BY recall DESC, f1 DESC, weights) AS rnk FROM vf)
SELECT recall, precision, accuracy, f1, roc_auc, 'm_a' AS model,
       CAST(NULL AS VARCHAR) AS weights FROM em
UNION ALL
SELECT recall, precision, accuracy, f1, CAST(NULL AS DOUBLE) AS roc_auc, 'soft_vote' AS model,
       weights FROM vr WHERE rnk = 1""")


def _eda_sql() -> str:
    from .eda import (CHURNED_HIST_CHARTS, CORR_COLS, COUNT_CHARTS, HIST_CHARTS,
                      PLAIN_COUNT_CHARTS)
    ctes, parts = [f"churned AS (SELECT * FROM binned WHERE churn_value = 1)"], []

    def counts(col, hue, chart):
        h = (f"coalesce(CAST({hue} AS VARCHAR), 'nan')" if hue else "CAST(NULL AS VARCHAR)")
        return (f"SELECT '{chart}' AS chart, 'count' AS kind, "
                f"coalesce(CAST({col} AS VARCHAR), 'nan') AS category, {h} AS hue, "
                f"CAST(NULL AS DOUBLE) AS bin_lo, CAST(NULL AS DOUBLE) AS bin_hi, "
                f"CAST(count(*) AS DOUBLE) AS value FROM binned GROUP BY 3, 4")

    for c in COUNT_CHARTS:
        parts.append(counts(c, None, f"count:{c}"))
        parts.append(counts(c, "churn_value", f"count:{c}|churn"))
    for c in PLAIN_COUNT_CHARTS:
        parts.append(counts(c, None, f"count:{c}"))
    i = 0
    for src, cols, suffix in (("binned", HIST_CHARTS, ""), ("churned", CHURNED_HIST_CHARTS,
                                                              "|churned")):
        for c in cols:
            p = f"e{i}_"
            i += 1
            cte, sel = hist_parts(p, src, c, 20, None)
            ctes.append(cte)
            ctes.append(f"{p}out AS ({sel})")
            parts.append(f"SELECT 'hist:{c}{suffix}' AS chart, 'histogram' AS kind, "
                         f"CAST(bin AS VARCHAR) AS category, hue, bin_lo, bin_hi, "
                         f"CAST(count AS DOUBLE) AS value FROM {p}out")
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT 'corr' AS chart, 'corr' AS kind, '{a}' AS category, "
                         f"'{b}' AS hue, CAST(NULL AS DOUBLE) AS bin_lo, "
                         f"CAST(NULL AS DOUBLE) AS bin_hi, round(CASE WHEN isnan(corr({a}, {b})) "
                         f"THEN NULL ELSE corr({a}, {b}) END, 6) AS value FROM binned")
    return f"WITH {BINNED_CTE},\n" + ",\n".join(ctes) + "\n" + union_all(parts)


register("eda_report", _eda_sql())
