import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.operators import ensemble, knn, ml


@pytest.fixture()
def small_fit(spark):
    rng = np.random.default_rng(123)
    n = 100
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 10, n)
    pdf = pd.DataFrame({"customer_id": np.arange(n), "num_a": a, "num_b": b,
                        "cat_c": rng.choice(["u", "v", "w"], n),
                        "label": ((5 * a + 0.5 * b) > 4).astype(float)})
    return spark.createDataFrame(pdf)


def test_split_is_stable_and_disjoint(small_fit):
    tr, te = ml.split(small_fit)
    a = {r.customer_id for r in tr.collect()}
    b = {r.customer_id for r in te.collect()}
    assert not a & b and len(a | b) == 100
    tr2, _ = ml.split(small_fit.repartition(7))
    assert {r.customer_id for r in tr2.collect()} == a


def test_folds_exactly_stratified(small_fit):
    f = ml.stratified_folds(small_fit, "label", k=5).groupBy("label", "fold").count().collect()
    by = {}
    for r in f:
        by.setdefault(r.label, []).append(r["count"])
    for counts in by.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_population_scaler(small_fit):
    m = ml.PopulationScaler(inputCols=["num_b"], outputCols=["z"]).fit(small_fit)
    z = np.array([r.z for r in m.transform(small_fit).collect()])
    assert z.mean() == pytest.approx(0, abs=1e-9) and z.std(ddof=0) == pytest.approx(1)


def test_roles(small_fit, spark):
    df = small_fit.withColumn("city", F.lit("x")).withColumn("few", F.col("customer_id") % 3)
    r = ml.select_features(df, ["num_a", "cat_c", "city", "few"])
    assert r.one_hot == ["cat_c", "city"] and r.scale == ["num_a"] and r.passthrough == ["few"]


def test_one_hot_unseen_is_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    stages, _ = ml.preprocessor_stages(ml.FeatureRoles(one_hot=["c"]))
    model = Pipeline(stages=stages).fit(train)
    out = [list(r.v) for r in model.transform(test).select(
        vector_to_array("features").alias("v")).collect()]
    assert out == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_compare_models_small_fit(small_fit, spark, tmp_path):
    data = ml.stratified_folds(small_fit, "label")
    train, test = ml.split(data)
    roles = ml.select_features(train, ["num_a", "num_b", "cat_c"])
    metrics, preds, tuned = ml.compare_models(train, test, roles, full_grid=False,
                                              names=["RandomForest"], parallelism=2)
    rows = {r.model: r for r in metrics.collect()}
    assert set(rows) == {"LogisticRegression", "RandomForest", ml.VOTING}
    assert rows["LogisticRegression"].recall >= 0.6
    assert preds.count() == 3 * test.count()
    assert sorted(r.rank for r in rows.values()) == [1, 2, 3]
    # the vote is the weighted mean of its members, chosen on out-of-fold predictions
    vote = tuned[ml.VOTING]
    names, weights = vote.params["models"].split(","), vote.model.weights
    by = {}
    for r in preds.collect():
        by.setdefault(r.customer_id, {})[r.model] = r.proba
    for p in by.values():
        assert p[ml.VOTING] == pytest.approx(
            sum(w * p[n] for n, w in zip(names, weights)) / sum(weights))
    best = {}
    oof = {n: {r.customer_id: r for r in tuned[n].oof.collect()} for n in names}
    assert all(len(o) == train.count() for o in oof.values())
    for w in ensemble.weight_candidates(len(names)):
        tp = fn = 0
        for k, r in oof[names[0]].items():
            p = sum(x * oof[n][k].proba for x, n in zip(w, names)) / sum(w)
            tp, fn = tp + (r.label == 1 and p > 0.5), fn + (r.label == 1 and p <= 0.5)
        best[w] = round(tp / (tp + fn), 6)
    assert vote.cv_metric == max(best.values())
    vote.model.save(spark, str(tmp_path / "vote"))
    again = ml.VotingModel.load(spark, str(tmp_path / "vote"))
    assert again.transform(test).select("customer_id", "prediction").exceptAll(
        vote.model.transform(test).select("customer_id", "prediction")).count() == 0
    # artifact round trip
    path = str(tmp_path / "m")
    best = tuned["LogisticRegression"].model
    best.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = ml.predictions(best, test, "x").orderBy("customer_id").collect()
    b = ml.predictions(loaded, test, "x").orderBy("customer_id").collect()
    assert [r.proba for r in a] == pytest.approx([r.proba for r in b])


def test_soft_vote_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    y = rng.integers(0, 2, n)
    probs = {m: np.round(rng.uniform(0, 1, n), 3) for m in ("a", "b", "c")}
    rows = [(m, int(i), int(y[i]), float(probs[m][i])) for m in probs for i in range(n)]
    pred = spark.createDataFrame(rows, "model string, customer_id long, label int, proba double")
    out = {r.weights: r for r in ensemble.soft_vote(pred, ["a", "b", "c"]).collect()}
    assert len(out) == 25
    for w in [(1, 1, 1), (3, 1, 2)]:
        p = (w[0] * probs["a"] + w[1] * probs["b"] + w[2] * probs["c"]) / sum(w)
        hit = p > 0.5
        tp = ((y == 1) & hit).sum()
        assert out[",".join(map(str, w))].recall == pytest.approx(tp / (y == 1).sum(), abs=1e-6)


def brute_knn(train, test, k, weights, p):
    out = {}
    for qid, qv in test:
        d = [(np.abs(qv - rv).sum() if p == 1 else np.sqrt(((qv - rv) ** 2).sum()), rid, lab)
             for rid, rv, lab in train]
        d.sort(key=lambda t: (t[0], t[1]))
        nn = d[:k]
        if weights == "uniform":
            out[qid] = sum(lab == 1 for _, _, lab in nn) / k
        else:
            if any(x[0] == 0 for x in nn):
                ws = [1.0 if x[0] == 0 else 0.0 for x in nn]
            else:
                ws = [1 / x[0] for x in nn]
            out[qid] = sum(w * (x[2] == 1) for w, x in zip(ws, nn)) / sum(ws)
    return out


@pytest.mark.parametrize("weights,p,block", [("uniform", 2, 20_000), ("distance", 1, 37),
                                             ("uniform", 1, 50)])
def test_knn_matches_brute_force_any_blocking(spark, weights, p, block):
    rng = np.random.default_rng(9)
    vecs = np.round(rng.normal(0, 1, (160, 4)), 1).astype(np.float32)
    vecs[5] = vecs[6]  # duplicate -> zero distance and ties
    labels = rng.integers(0, 3, 160)
    rows = [(int(i), [float(x) for x in vecs[i]], int(labels[i])) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    train, test = df.filter("vec_id % 4 != 0"), df.filter("vec_id % 4 = 0 OR vec_id = 6")
    got = {r.vec_id: r.knn_score for r in knn.knn_score(
        train, test, k=3, weights=weights, p=p, block_rows=block).collect()}
    tr = [(int(i), vecs[i].astype(np.float64), int(labels[i])) for i in range(160) if i % 4]
    te = [(int(i), vecs[i].astype(np.float64)) for i in range(160) if i % 4 == 0 or i == 6]
    want = brute_knn(tr, te, 3, weights, p)
    assert set(got) == set(want)
    for q, v in want.items():
        assert got[q] == pytest.approx(v, abs=1e-6)


def test_full_param_grid_sizes(small_fit):
    roles = ml.FeatureRoles(one_hot=["cat_c"], scale=["num_a", "num_b"])
    pipes = ml.model_pipelines(roles)
    full = ml.param_grids(pipes, 80, full=True)
    assert {k: len(v) for k, v in full.items()} == {
        "LogisticRegression": 16, "RandomForest": 288, "GaussianNB": 4}
    lr = pipes["LogisticRegression"].getStages()[-1]
    regs = sorted({m[lr.regParam] for m in full["LogisticRegression"]})
    assert regs == pytest.approx(sorted(1 / (c * 80) for c in (0.1, 0.5, 1, 5)))


def test_soft_vote_metric_choice(spark):
    rows = [("a", i, i % 2, 0.9 if i % 2 else 0.6) for i in range(40)] + \
           [("b", i, i % 2, 0.2) for i in range(40)]
    pred = spark.createDataFrame(rows, "model string, customer_id long, label int, proba double")
    by_recall = ensemble.soft_vote(pred, ["a", "b"], metric="recall").filter("rank = 1").first()
    by_prec = ensemble.soft_vote(pred, ["a", "b"], metric="precision").filter("rank = 1").first()
    assert by_recall.recall >= by_prec.recall and by_prec.precision >= by_recall.precision
    with pytest.raises(ValueError):
        ensemble.soft_vote(pred, ["a", "b"], metric="nope")


def test_folds_with_a_hot_repeated_key(spark):
    base = [(i, i % 2) for i in range(600)]
    hot = [(7, 1)] * 400  # one key repeated in 40% of the rows
    df = spark.createDataFrame(base + hot, "customer_id long, label int").repartition(5)
    f = ml.stratified_folds(df, "label", copies_per_group=37)
    assert f.count() == 1000
    counts = {}
    for r in f.groupBy("label", "fold").count().collect():
        counts.setdefault(r.label, []).append(r["count"])
    for c in counts.values():
        assert len(c) == 5 and max(c) - min(c) <= 1


def test_folds_keep_null_labels_and_keys(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (None, 1.0), (3, None), (None, None)],
                               "customer_id long, label double")
    assert ml.stratified_folds(df, "label").count() == 5


def test_boolean_feature_is_one_hot(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([(i, bool(i % 2), float(i)) for i in range(12)],
                               "customer_id long, flag boolean, num double")
    roles = ml.select_features(df, ["flag", "num"])
    assert roles.one_hot == ["flag"] and roles.scale == ["num"]
    stages, _ = ml.preprocessor_stages(roles)
    out = Pipeline(stages=stages).fit(df).transform(df).select("features").first()[0]
    assert len(out) == 3  # false, true, scaled


def test_vote_without_some_predictions(spark):
    pred = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 1, 0.8), (2, "a", 1, 0.9),
                                  (3, "a", 0, 0.2), (3, "b", 0, 0.1)],
                                 "customer_id long, model string, label int, proba double")
    got = ensemble.soft_vote(pred, ["a", "b"], weights=[(1, 1)]).first()
    assert got.recall == 1.0 and got.accuracy == 1.0
    lost = ensemble.soft_vote(pred.where("customer_id <> 2").union(spark.createDataFrame(
        [(2, "c", 1, 0.9)], pred.schema)), ["a", "b"], weights=[(1, 1)]).first()
    assert lost.recall == 0.5  # a key no listed model has judged is class 0


def test_tuner_equals_cross_validator(small_fit):
    from pyspark.ml.tuning import CrossValidator
    data = ml.stratified_folds(ml.add_class_weights(small_fit), "label")
    roles = ml.select_features(data, ["num_a", "num_b", "cat_c"])
    pipe = ml.model_pipelines(roles, names=["LogisticRegression"])["LogisticRegression"]
    grid = ml.param_grids({"LogisticRegression": pipe}, 80, full=False)["LogisticRegression"]
    want = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ml.recall_evaluator(),
                          foldCol="fold", numFolds=5).fit(data).avgMetrics
    got = ml.cross_validate(pipe.getStages()[-1], grid, ml.encoded_folds(pipe, data, "label"), "label", 4)
    assert got == pytest.approx(want, abs=1e-9)
    assert ml.tune("LogisticRegression", pipe, grid, data).cv_metric == pytest.approx(max(want))


def test_saved_model_is_told_from_a_damaged_one(spark, tmp_path):
    assert not ml.is_saved(spark, str(tmp_path / "none"))
    (tmp_path / "bad" / "metadata").mkdir(parents=True)
    (tmp_path / "bad" / "metadata" / "part-00000").write_text("not json")
    from pyspark.ml import Pipeline
    with pytest.raises(Exception):
        ml.deploy(Pipeline(stages=[]), spark.range(1), str(tmp_path / "bad"))
    assert (tmp_path / "bad" / "metadata" / "part-00000").read_text() == "not json"
