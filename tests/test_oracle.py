"""Spark queries vs their DuckDB oracles at sf0.001 (a fast subset; the full
set runs with tools/compare_oracle.py at sf0.01)."""
import duckdb
import pytest

import __spark_entry__ as E
from retentio.sources.tables import TABLES
from tools.compare_oracle import duck_type, rows_key

SF = "/root/testdata/sf0.001"
SUBSET = ["customer_360", "clean_customers", "null_counts", "topk_isin", "describe",
          "histogram_hue", "count_distinct", "mode", "chi2_scan", "profit_curve",
          "roc_auc", "eval_metrics", "abc_assign", "impute_conditional", "stratified_folds",
          "soft_vote", "knn_score", "one_hot", "eda_report", "kde"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql()[name]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    dtypes = {r[0]: duck_type(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert sorted(df.columns) == sorted(dcols)
    for c, t in df.dtypes:
        assert t == dtypes[c] or (t == "timestamp" and dtypes[c] == "timestamp_ntz"), c
    assert len(srows) == len(drows)
    assert rows_key(df.columns, srows) == rows_key(dcols, drows)
