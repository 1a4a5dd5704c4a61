import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import decision


def brute_profit(labels, proba, value, cost, rate):
    labels, proba = np.asarray(labels), np.asarray(proba)
    out = {}
    for i in range(50, 951):
        t = i / 1000.0
        pred = proba > t
        tp = int(((labels == 1) & pred).sum())
        fp = int(((labels == 0) & pred).sum())
        fn = int(((labels == 1) & ~pred).sum())
        out[t] = tp * (value * rate - cost) - fp * cost - fn * value
    best_t = max(out.items(), key=lambda kv: kv[1])[0]  # first max = smallest threshold
    return best_t, out[best_t], out


def run_curve(spark, labels, proba, value, cost, rate):
    df = spark.createDataFrame([(int(l), float(p)) for l, p in zip(labels, proba)],
                               "label int, proba double")
    curve = decision.profit_curve(df, value, cost, rate, label="label", proba="proba")
    best = decision.best_threshold(curve).first()
    return best, {r.threshold: r.profit for r in curve.collect()}


@pytest.mark.parametrize("labels,proba,value,cost,rate", [
    ([1, 0, 1, 0, 1], [.9, .1, .8, .2, .7], 100, 10, .5),
    ([1, 1, 0, 0], [.8, .7, .2, .1], 200, 20, .6),
    ([0, 1, 1], [.1, .2, .3], 100, 20, .3),
    ([1, 1, 1, 1, 1], [.9, .8, .85, .95, .7], 100, 10, .5),
])
def test_profit_fixtures_against_brute_force(spark, labels, proba, value, cost, rate):
    best, curve = run_curve(spark, labels, proba, value, cost, rate)
    bt, bp, bcurve = brute_profit(labels, proba, value, cost, rate)
    assert len(curve) == 901
    assert best.threshold == bt and best.best_profit == pytest.approx(bp)
    for t, p in bcurve.items():
        assert curve[t] == pytest.approx(p)


def test_profit_fixture_3_values(spark):
    best, _ = run_curve(spark, [0, 1, 1], [.1, .2, .3], 100, 20, .3)
    assert best.threshold == 0.1 and best.best_profit == 20.0


def test_profit_scores_on_grid_values(spark):
    rng = np.random.default_rng(3)
    proba = np.concatenate([np.round(rng.uniform(0, 1, 1200), 3), rng.uniform(0, 1, 300),
                            [0.05, 0.95, 0.0, 1.0, 0.0505, 0.9495]])
    labels = (rng.uniform(0, 1, len(proba)) < proba).astype(int)
    best, curve = run_curve(spark, labels, proba, 4000, 100, .8)
    bt, bp, bcurve = brute_profit(labels, proba, 4000, 100, .8)
    assert best.threshold == bt
    assert all(curve[t] == pytest.approx(p) for t, p in bcurve.items())


def test_profit_validation(spark):
    df = spark.createDataFrame([(1, .5)], "label int, proba double")
    with pytest.raises(ValueError):
        decision.profit_curve(df, -1, 1, .5, label="label", proba="proba")
    with pytest.raises(ValueError):
        decision.profit_curve(df, 1, 1, 1.5, label="label", proba="proba")


def test_roc_auc_matches_pairwise_count(spark):
    rng = np.random.default_rng(11)
    proba = np.round(rng.uniform(0, 1, 700), 2)  # many ties
    labels = (rng.uniform(0, 1, 700) < proba).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, proba)],
                               "y int, p double")
    got = decision.roc_auc(df, "y", "p").first().roc_auc
    pos, neg = proba[labels == 1], proba[labels == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum())
    assert got == pytest.approx(want / (len(pos) * len(neg)), abs=1e-6)


def test_confusion_forces_both_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "churn_value int, prediction int")
    r = decision.confusion(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 2)
    m = decision.metrics_from_confusion(decision.confusion(df)).first()
    assert m.recall == 1.0 and m.precision == 1.0


def test_score_and_top_n(spark):
    df = spark.createDataFrame([(1, .8, "Month-to-month"), (2, .1, "Two year"),
                                (3, .8, "Month-to-month")],
                               "customer_id int, churn_probability double, contract string")
    s = decision.score(df, 0.8)
    assert [r.intervention_flag for r in s.orderBy("customer_id").collect()] == [1, 0, 1]
    top = decision.top_n_scored(s, "bad").collect()
    assert [r.customer_id for r in top] == [1, 3, 2]
    with pytest.raises(ValueError):
        decision.score(df, 1.5)


def test_abc_assign_stable_and_complete(spark):
    df = spark.range(3000).select(F.col("id").alias("customer_id"),
                                  F.lit(1).alias("intervention_flag"),
                                  F.lit("Month-to-month").alias("contract"))
    a = {r.customer_id: r.group for r in decision.abc_assign(df).collect()}
    b = {r.customer_id: r.group for r in decision.abc_assign(df.repartition(7)).collect()}
    assert a == b and len(a) == 3000
    counts = {g: list(a.values()).count(g) for g in decision.GROUPS}
    assert all(900 < c < 1100 for c in counts.values())
    c = {r.customer_id: r.group for r in decision.abc_assign(df, seed=7).collect()}
    assert c != a
    empty = decision.abc_assign(df.filter("customer_id < 0"))
    assert empty.count() == 0 and "group" in empty.columns


def test_roc_auc_of_one_class_is_null_and_large_counts_do_not_overflow(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    assert decision.roc_auc(one, "y", "p").first().roc_auc is None
    assert decision.roc_auc(one.limit(0), "y", "p").first().roc_auc is None
    m = decision.eval_metrics(one, "y", "p").first()
    assert m.roc_auc is None and m.recall == 0.5


def test_roc_auc_of_scores_piled_up_near_zero(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    p = rng.random(400) ** 30
    y = (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(5)
    wins = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
    assert decision.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(
        wins / ((y == 1).sum() * (y == 0).sum()), abs=1e-6)


def test_readout_profit_and_roi(spark):
    rows = [(g, int(i < churned)) for g, n, churned in (
        ("A (Control)", 100, 50), ("B (Price Offer)", 100, 30), ("C (Service Offer)", 50, 25))
        for i in range(n)]
    df = spark.createDataFrame(rows, "group string, churn_value int")
    costs = {"B (Price Offer)": 10.0, "C (Service Offer)": 20.0}
    got = {r.group: r for r in decision.abc_readout(df, value=100.0, costs=costs).collect()}
    assert (got["B (Price Offer)"].profit, got["B (Price Offer)"].roi) == (1000.0, 1.0)
    assert got["C (Service Offer)"].profit_per_customer == -20.0
    assert got["A (Control)"].profit is None and got["A (Control)"].roi is None
