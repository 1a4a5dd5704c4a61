"""End-to-end jobs (survey §3), built from the operators.

A. ``profile_job``     clean -> summaries -> EDA report
B. ``train_deploy_job`` clean -> bin -> split/folds -> compare models -> refit
                        best on all rows -> save
C. ``threshold_score_assign_job``  profit-optimal threshold on the best
                        model's test predictions -> score -> A/B/C groups
D. ``score_explain_job`` score with a given threshold -> Shapley
                        contributions (local top-10 and global top-10)

Only bounded results reach the driver (one best threshold, one row per
model); all per-customer work stays in Spark.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, clean, decision, explain, ml
from ..operators.quantiles import medians
from ..session import cut_lineage, shared_path
from ..sources.mart import customer_360
from .eda import eda_report

ML_FEATURES = ("city", "monthly_charges", "contract", "internet_service", "payment_method",
               "tenure_group")
CATEGORICAL = ("city", "contract", "internet_service", "payment_method", "tenure_group")


def clean_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the mart is used twice by the top-k city step: materialise it once
    return binning.bin_all(clean.clean_customers(cut_lineage(customer_360(spark, sf_dir))))


def model_frame(binned: DataFrame, raw_contract: bool = False) -> DataFrame:
    """Key, label and features; ``raw_contract`` keeps the unfilled contract beside them."""
    df = binned.withColumn("label", F.col("churn_value").cast("double"))
    extra = [F.col("contract").alias("contract_raw")] if raw_contract else []
    return ml.fill_categoricals(df.select("customer_id", "label", *ML_FEATURES, *extra),
                                list(CATEGORICAL))


def profile_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda_report(clean_binned(spark, sf_dir))


@dataclass
class TrainResult:
    metrics: DataFrame
    predictions: DataFrame
    best_name: str
    model: PipelineModel
    roles: ml.FeatureRoles


MARKER = "version string, saved_at timestamp"


def _load_bundle(spark: SparkSession, path: str) -> TrainResult | None:
    """The bundle that the newest marker names, or None when none was ever completed.

    Errors other than a missing path are raised.
    """
    try:
        marker = (spark.read.schema(MARKER).json(f"{path}/markers")
                  .orderBy(F.desc("saved_at"), F.desc("version")).first())  # one row per training
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if marker is None:
        return None
    at = f"{path}/versions/{marker['version']}"
    metrics = spark.read.parquet(f"{at}/metrics")
    best = metrics.filter(F.col("rank") == 1).select("model").first()[0]  # one row
    model = (ml.VotingModel.load(spark, f"{at}/model") if best == ml.VOTING
             else PipelineModel.load(f"{at}/model"))
    roles_row = spark.read.json(f"{at}/roles").first()
    roles = ml.FeatureRoles(*(list(roles_row[c] or []) for c in ("one_hot", "scale", "passthrough")))
    return TrainResult(metrics, spark.read.parquet(f"{at}/predictions"), best, model, roles)


def _save_bundle(spark: SparkSession, path: str, result: TrainResult) -> None:
    """Write everything into a folder of its own, then one small marker that names it.

    Readers only follow markers: whatever stops a save leaves the bundle before
    it in force, and a load during a save gets one bundle or the other, whole.
    """
    version = uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    if isinstance(result.model, ml.VotingModel):
        result.model.save(spark, f"{at}/model")
    else:
        result.model.write().save(f"{at}/model")
    result.metrics.write.parquet(f"{at}/metrics")
    result.predictions.write.parquet(f"{at}/predictions")
    r = result.roles
    spark.createDataFrame([(r.one_hot, r.scale, r.passthrough)],
                          "one_hot array<string>, scale array<string>, passthrough array<string>").write.json(f"{at}/roles")
    (spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("saved_at"))
     .coalesce(1).write.mode("append").json(f"{path}/markers"))


def path_tag(path: str) -> str:
    """A folder name for results that belong to one input path."""
    return hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:16]


def _refit(name: str, tuned: PipelineModel, roles: ml.FeatureRoles, data, train_share: float
           ) -> PipelineModel:
    """The tuned candidate fitted on all rows.  Its C is kept: regParam is 1 / (C rows)."""
    pipe = ml.model_pipelines(roles, names=[name])[name]
    clf = pipe.getStages()[-1]
    for p, v in tuned.stages[-1].extractParamMap().items():
        if clf.hasParam(p.name):
            clf.set(clf.getParam(p.name), v * train_share if p.name == "regParam" else v)
    return pipe.fit(data)


def train_deploy_job(spark: SparkSession, sf_dir: str, path: str | None = None,
                     full_grid: bool = True, overwrite: bool = True) -> TrainResult:
    """Compare models, refit the best on all rows and save the bundle (model,
    ranked metrics, test predictions, feature roles) under ``path``.  With
    ``overwrite=False`` a complete saved bundle is loaded instead of training
    (load-or-train)."""
    path = path or shared_path(spark, f"models/best_{path_tag(sf_dir)}_{'full' if full_grid else 'sub'}")
    if not overwrite:
        saved = _load_bundle(spark, path)
        if saved is not None:
            return saved
    data = cut_lineage(model_frame(clean_binned(spark, sf_dir)))
    train, test = ml.split(data)
    train = cut_lineage(ml.stratified_folds(train, "label"))
    roles = ml.select_features(data, ML_FEATURES)  # over all rows
    metrics, preds, tuned = ml.compare_models(train, test, roles, full_grid=full_grid)
    metrics = cut_lineage(metrics)
    best_name = metrics.filter(F.col("rank") == 1).select("model").first()[0]  # one row
    weighted = cut_lineage(ml.add_class_weights(data))
    share = train.count() / max(1, data.count())
    if best_name == ml.VOTING:
        vote = tuned[best_name].model
        model = ml.VotingModel({n: _refit(n, tuned[n].model, roles, weighted, share)
                                for n in vote.models}, vote.weights)
    else:
        model = _refit(best_name, tuned[best_name].model, roles, weighted, share)
    _save_bundle(spark, path, TrainResult(metrics, preds, best_name, model, roles))
    return _load_bundle(spark, path)


def threshold_score_assign_job(spark: SparkSession, sf_dir: str, result: TrainResult,
                               cost: float = 100.0, retention_rate: float = 0.8
                               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(curve, scored, assigned)``; the threshold comes from the
    profit curve of the best model's test predictions, the value from the
    median CLTV of the full raw table."""
    mart = cut_lineage(customer_360(spark, sf_dir))
    value = medians(mart, ["cltv"])["cltv"]
    best_pred = result.predictions.filter(F.col("model") == result.best_name)
    curve = decision.profit_curve(best_pred, value, cost, retention_rate, label="label",
                                  proba="proba")
    t = decision.best_threshold(curve).first()["threshold"]  # one row
    binned = binning.bin_all(clean.clean_customers(mart))
    scored = ml.score_with_model(result.model, model_frame(binned, raw_contract=True), t)
    scored = scored.withColumn("contract", F.col("contract_raw")).drop("contract_raw")
    return curve, scored, decision.abc_assign(scored)


def score_explain_job(spark: SparkSession, sf_dir: str, model: PipelineModel,
                      threshold: float = 0.5, samples: int = 32, roles: ml.FeatureRoles | None = None
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(scored, local_top10, global_top10)`` for the test rows.

    A forest (with its ``roles``) is explained by its trees, any other single
    model by weighted coalitions, a vote by sampled orders.
    """
    data = model_frame(clean_binned(spark, sf_dir))
    train, test = ml.split(data)
    scored = ml.score_with_model(model, test, threshold)
    bg = explain.background_sample(model, train, list(ML_FEATURES)) if not explain.is_tree(model) else None
    phi = explain.contributions(model, test, bg, list(ML_FEATURES), roles, samples=samples)
    return scored, explain.explain_local(phi), explain.explain_global(phi)
