import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"tenure_group", "customers", "churn_rate"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


# queries that fit models or run actions while being built; they are
# exercised by their own tests and by the oracle/rows check
EAGER = {"baseline_cv", "tune", "compare_models", "feature_importance", "deploy",
         "score_model", "explain_linear", "background_sample", "explain_local",
         "explain_global", "train_deploy", "threshold_score_assign", "stream_score",
         "score_explain",
         "one_hot", "scale", "sink_scored", "kde", "knn_score", "knn_score_distance",
         "drop_rows_by_key", "impute_conditional"}


def test_registered_queries_plan(spark):
    # every lazy query must analyse (schema) at the smallest scale
    for name, q in E.queries().items():
        if name not in EAGER:
            assert q(spark, "/root/testdata/sf0.001").schema is not None, name
