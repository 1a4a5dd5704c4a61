import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrameWriter

from retentio.operators import ml
from retentio.plans import jobs


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 2)) for i in range(60)], "customer_id long, a double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LogisticRegression()]).fit(df)

    def named(name):
        metrics = spark.createDataFrame([(name, 1)], "model string, rank int")
        return jobs.TrainResult(metrics, ml.predictions(model, df, name), name, model, ml.FeatureRoles(scale=["a"]))

    return named


def test_newest_complete_bundle_is_loaded(spark, result, tmp_path):
    path = str(tmp_path / "b")
    assert jobs._load_bundle(spark, path) is None
    jobs._save_bundle(spark, path, result("first"))
    assert jobs._load_bundle(spark, path).best_name == "first"
    jobs._save_bundle(spark, path, result("second"))
    got = jobs._load_bundle(spark, path)
    assert got.best_name == "second" and got.predictions.select("model").distinct().first()[0] == "second"
    assert got.roles.scale == ["a"] and got.roles.one_hot == []


@pytest.mark.parametrize("step", range(4))
def test_a_save_that_stops_leaves_the_bundle_before_it(spark, result, tmp_path, monkeypatch, step):
    path = str(tmp_path / "b")
    jobs._save_bundle(spark, path, result("whole"))
    later, done = result("broken"), []

    def stopping(inner):
        def write(self, at, *a, **k):
            if "/versions/" in at or "/markers" in at:
                if len(done) == step:
                    raise OSError("stopped")
                done.append(at)
            return inner(self, at, *a, **k)
        return write

    for name in ("parquet", "json"):
        monkeypatch.setattr(DataFrameWriter, name, stopping(getattr(DataFrameWriter, name)))
    with pytest.raises(OSError):
        jobs._save_bundle(spark, path, later)
    monkeypatch.undo()
    assert len(done) == step  # metrics, predictions, roles, marker
    got = jobs._load_bundle(spark, path)
    assert got.best_name == "whole" and got.predictions.count() == 60
    assert ml.score_with_model(got.model, got.predictions.selectExpr("customer_id", "1.0D AS a"), 0.5).count() == 60
