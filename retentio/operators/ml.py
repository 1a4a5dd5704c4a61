"""Model training, tuning and comparison with ``pyspark.ml`` (survey §2.8).

Scale notes
-----------
* The train/test split and (for unique keys) the CV folds are functions of
  a keyed md5 hash, not ``randomSplit``: they do not change with
  partitioning or retries.  Copies of a repeated key are numbered by an
  internal row id, stable as long as the input partitioning is.
* Folds are exactly stratified without a window over a whole class or a
  whole repeated key: distinct (class, key) groups are ranked through 4,096
  hash buckets (bucket offsets from a small grouped table, in-bucket ranks
  from a window per bucket), copies of a key through salted sub-groups.
* Feature-role cardinalities are exact distinct counts, de-duplicated
  map-side, in one aggregate.
* Fits are Spark jobs started side by side from driver threads.  The training
  frame and the encoded folds are written as parquet tables under
  ``spark.checkpoint.dir``, so every candidate reads vectors and lost executors
  re-read files instead of recomputing the raw tables.  A comparison encodes
  the folds once for all its models and tunes the models side by side.
* Forests keep the node of every row between levels (``cacheNodeIds``): the same
  trees without walking each row down from the root at every level.
* An iterative fit runs a job per step, so its cost on small folds is that of
  starting tasks: logistic and Bayes fits and all evaluations read a fold in
  tasks of ``ROWS_PER_TASK`` rows.  Forests keep the fold's partitions, which
  their bootstrap draws follow.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target, keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import md5_unit
from ..session import cut_lineage
from . import decision, ensemble, forest, profile
from .bayes import GaussianBayes
from .clean import require_columns

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")
ONE_HOT_MAX_DISTINCT = 5          # fixed value: one-hot when <= 5 distinct
ALWAYS_ONE_HOT = ("city",)         # fixed value: always one-hot encoded
SCALE_MIN_DISTINCT = 5             # fixed value: scale numerics with > 5 distinct
ROWS_PER_TASK = 100_000            # of an encoded fold


# ------------------------------------------------------------------ split
def split(df: DataFrame, key: str = "customer_id", test_size: float = 0.2, seed: int = 123
          ) -> tuple[DataFrame, DataFrame]:
    """Random (not stratified) train/test split by keyed hash."""
    u = md5_unit(key, seed)
    return df.filter(u >= test_size), df.filter(u < test_size)


def split_label(df: DataFrame, key: str = "customer_id", test_size: float = 0.2,
                seed: int = 123) -> DataFrame:
    return df.withColumn("split", F.when(md5_unit(key, seed) < test_size, "test")
                         .otherwise("train"))


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet; the key columns appear once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def stratified_folds(df: DataFrame, label: str, key: str = "customer_id", k: int = 5,
                     seed: int = 123, buckets: int = 4096, copies_per_group: int = 1_000_000
                     ) -> DataFrame:
    """Add ``fold`` in 0..k-1: within each class, rows ordered by a keyed
    hash (key, then an internal row id, break ties) are dealt round-robin, so
    every fold holds floor/ceil(n_class / k) rows of each class.

    No window ever covers a whole class or a whole repeated key:

    1. distinct (class, key) groups with their row counts (partial
       aggregation, so a key repeated in a third of all rows is combined
       map-side);
    2. each group's first rank = rows of its class in earlier hash buckets
       (a window over at most classes x ``buckets`` bucket totals) plus rows
       of earlier groups in its own bucket (a window per bucket; distinct
       keys hash uniformly, so buckets stay balanced);
    3. copies of one key are numbered in salted sub-groups of about
       ``copies_per_group`` rows (sub-group offsets from a window over at most
       count / ``copies_per_group`` rows per key).
    For unique keys this is exactly "row_number by (hash, key) within class".
    A NULL label is a class of its own and a NULL key a key: no row is lost.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"),
                                              F.lit(f"fold{seed}"))), 1, 12), 16, 10)
    x = (df.withColumn("_h", h.cast("bigint"))
         .withColumn("_rid", F.monotonically_increasing_id()))
    # 1. one row per (class, key) with its number of copies
    groups = x.groupBy(label, "_h", key).agg(F.count(F.lit(1)).alias("_c"))
    groups = groups.withColumn(
        "_b", (F.col("_h") * buckets / F.lit(float(1 << 48))).cast("int"))
    # 2. first rank of every group inside its class
    per_b = groups.groupBy(label, "_b").agg(F.sum("_c").alias("_n"))
    w_off = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_b.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0)))
    w_in = (Window.partitionBy(label, "_b").orderBy("_h", key)
            .rowsBetween(Window.unboundedPreceding, -1))
    starts = (_join_null_safe(groups, offsets.select(label, "_b", "_off"), [label, "_b"])
              .withColumn("_start", F.col("_off")
                          + F.coalesce(F.sum("_c").over(w_in), F.lit(0)))
              .select(label, "_h", key, "_c", "_start"))
    # 3. number the copies of each key in salted sub-groups
    rows = _join_null_safe(x, starts, [label, "_h", key]).withColumn(
        "_s", F.pmod(F.col("_rid"), F.ceil(F.col("_c") / F.lit(copies_per_group))))
    sub = rows.groupBy(label, key, "_s").agg(F.count(F.lit(1)).alias("_sn"))
    w_sub = Window.partitionBy(label, key).orderBy("_s").rowsBetween(
        Window.unboundedPreceding, -1)
    sub = sub.withColumn("_soff", F.coalesce(F.sum("_sn").over(w_sub), F.lit(0))).drop("_sn")
    w_copy = Window.partitionBy(label, key, "_s").orderBy("_rid")
    ranked = (_join_null_safe(rows, sub, [label, key, "_s"])
              .withColumn("_rank", F.col("_start") + F.col("_soff")
                          + F.row_number().over(w_copy) - 1))
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop(
        "_h", "_rid", "_c", "_start", "_s", "_soff", "_rank")


# ------------------------------------------------------------------ roles
@dataclass
class FeatureRoles:
    one_hot: list[str] = field(default_factory=list)
    scale: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)


def feature_roles_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(column, dtype, n_distinct, role)`` from one aggregate."""
    require_columns(df, *features)
    dtypes = dict(df.dtypes)
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in features])
    long = wide.unpivot([], list(features), "column", "n_distinct")
    meta = df.sparkSession.createDataFrame([(c, dtypes[c]) for c in features],
                                           "column string, dtype string")
    t = meta.join(F.broadcast(long), "column")
    return t.withColumn("role", _role(F.col("column"), F.col("dtype"), F.col("n_distinct")))


def _role(column: Column, dtype: Column, n_distinct: Column) -> Column:
    is_cat = dtype.isin("string", "boolean")
    is_num = dtype.isin(*NUMERIC)
    return (F.when((is_cat & (n_distinct <= ONE_HOT_MAX_DISTINCT)) | F.lower(column).isin(*ALWAYS_ONE_HOT), "one_hot")
            .when(is_num & (n_distinct > SCALE_MIN_DISTINCT), "scale").otherwise("passthrough"))


def select_features(df: DataFrame, features: Sequence[str]) -> FeatureRoles:
    """The roles of ``feature_roles_table`` as lists.

    Only whether a column has more than five values matters, so its distinct
    values are counted up to six (``profile.few_distinct``).
    """
    few = profile.few_distinct(df, features, max(ONE_HOT_MAX_DISTINCT, SCALE_MIN_DISTINCT) + 1)
    dtypes = dict(df.dtypes)
    rows = df.sparkSession.createDataFrame([(c, dtypes[c], few[c]) for c in few], "c string, t string, n int")
    role = {r["c"]: r["r"] for r in rows.select("c", _role(F.col("c"), F.col("t"), F.col("n")).alias("r")).collect()}
    pick = lambda name: [c for c in features if role[c] == name]
    return FeatureRoles(pick("one_hot"), pick("scale"), pick("passthrough"))


# ------------------------------------------------------------------ scaler
class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable,
                       DefaultParamsWritable):
    """Standardise columns to mean 0 and population std 1.

    ``ml.feature.StandardScaler`` divides by the sample std and centres
    only on request; this estimator matches the reference's scaler.  Fit
    is one aggregate; the model applies column expressions (codegen'd).
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                     means=means, stds=stds)


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable,
                            DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(),
                              self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            scaled = (F.col(c).cast("double") - m) / (s if s > 0 else 1.0)
            out = out.withColumn(o, scaled)
        return out


# ------------------------------------------------------------------ pipelines
def fill_categoricals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> 'nan' so a missing value is a category of its own."""
    return df.fillna("nan", subset=list(cols)) if cols else df


class TextColumns(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Copies of categorical columns as text (a string indexer takes no booleans)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select("*", *[F.col(c).cast("string").alias(o) for c, o in zip(
            self.getInputCols(), self.getOutputCols())])


def preprocessor_stages(roles: FeatureRoles) -> tuple[list, list[str]]:
    """Stages producing ``features`` and the human-readable slot names."""
    stages: list = []
    vec_inputs: list[str] = []
    if roles.one_hot:
        text = [f"{c}__text" for c in roles.one_hot]
        idx = [f"{c}__idx" for c in roles.one_hot]
        ohe = [f"{c}__ohe" for c in roles.one_hot]
        stages += [TextColumns(inputCols=roles.one_hot, outputCols=text),
                   StringIndexer(inputCols=text, outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]
        vec_inputs += ohe
    if roles.scale:
        out = [f"{c}__scaled" for c in roles.scale]
        stages.append(PopulationScaler(inputCols=roles.scale, outputCols=out))
        vec_inputs += out
    vec_inputs += roles.passthrough
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol="features",
                                  handleInvalid="keep"))
    return stages, vec_inputs


def slot_names(model: PipelineModel, roles: FeatureRoles) -> list[str]:
    """Names of the assembled feature slots (after one-hot expansion)."""
    names: list[str] = []
    indexer = next((s for s in model.stages if hasattr(s, "labelsArray")), None)
    if indexer is not None:
        for c, labels in zip(roles.one_hot, indexer.labelsArray):
            names += [f"{c}_{v}" for v in labels]
    names += list(roles.scale) + list(roles.passthrough)
    return names


def classifiers(label: str = "label", seed: int = 123) -> dict[str, object]:
    """Candidate classifiers; logistic regression is always included."""
    common = dict(featuresCol="features", labelCol=label)
    return {
        # tol 1e-4 and 100 iterations: the public scikit-learn defaults the
        # reference runs with (Spark's default tolerance is 1e-6)
        "LogisticRegression": LogisticRegression(standardization=False, maxIter=100,
                                                 tol=1e-4, **common),
        # no checkpoints of the cached nodes: their lineage is one step per level
        "RandomForest": RandomForestClassifier(seed=seed, cacheNodeIds=True, checkpointInterval=-1, **common),
        "GaussianNB": GaussianBayes(**common),
    }


def model_pipelines(roles: FeatureRoles, label: str = "label", seed: int = 123,
                    names: Sequence[str] | None = None) -> dict[str, Pipeline]:
    stages, _ = preprocessor_stages(roles)
    models = classifiers(label, seed)
    chosen = ["LogisticRegression"] + [n for n in (names or models) if n != "LogisticRegression"]
    return {n: Pipeline(stages=list(stages) + [models[n]]) for n in chosen if n in models}


def param_grids(pipelines: Mapping[str, Pipeline], n_train: int, full: bool = True,
                weight_cols: tuple[str, str] = ("w_balanced", "w_one")) -> dict[str, list]:
    """Spark equivalents of the reference grids.

    logistic: penalty l1/l2 -> elasticNetParam 1/0, C -> regParam 1/(C n),
    class_weight balanced/None -> weightCol (16 candidates);
    random forest: n_estimators -> numTrees, max_depth -> maxDepth,
    min_samples_leaf -> minInstancesPerNode, max_features sqrt/log2/None ->
    featureSubsetStrategy sqrt/log2/all, class_weight -> weightCol (288);
    Gaussian NB: var_smoothing -> varSmoothing (4).
    ``full=False`` keeps a small sub-grid for tests.
    """
    grids = {}
    for name, pipe in pipelines.items():
        clf = pipe.getStages()[-1]
        b = ParamGridBuilder()
        if isinstance(clf, LogisticRegression):
            cs = [0.1, 0.5, 1, 5] if full else [0.5, 5]
            b = (b.addGrid(clf.elasticNetParam, [1.0, 0.0] if full else [0.0])
                 .addGrid(clf.regParam, [1.0 / (c * n_train) for c in cs])
                 .addGrid(clf.weightCol, list(weight_cols)))
        elif isinstance(clf, RandomForestClassifier):
            b = (b.addGrid(clf.numTrees, [15, 20, 25, 30] if full else [20])
                 .addGrid(clf.maxDepth, [2, 5, 10, 15] if full else [5])
                 .addGrid(clf.minInstancesPerNode, [5, 10, 15] if full else [5])
                 .addGrid(clf.featureSubsetStrategy, ["sqrt", "log2", "all"] if full
                          else ["sqrt"])
                 .addGrid(clf.weightCol, list(weight_cols)))
        elif isinstance(clf, GaussianBayes):
            b = b.addGrid(clf.varSmoothing, [1e-9, 1e-7, 1e-5, 1e-3] if full else [1e-9])
        grids[name] = b.build()
    return grids


def add_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``w_balanced = n / (2 n_class)`` and ``w_one = 1`` (class_weight)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.agg(F.count(F.lit(1))).scalar()
    return (df.join(counts, label)
            .withColumn("w_balanced", n / (2.0 * F.col("_nc")))
            .withColumn("w_one", F.lit(1.0)).drop("_nc"))


def recall_evaluator(label: str = "label") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                             metricName="recallByLabel", metricLabel=1.0)


# ------------------------------------------------------------------ training
@dataclass
class TuneResult:
    name: str
    model: PipelineModel | None
    params: dict
    cv_metric: float | None
    error: str | None = None
    oof: DataFrame | None = None  # (key, label, proba) of the best candidate, out of fold


def _param_dict(pmap) -> dict:
    return {p.name: (v if isinstance(v, (int, float, str)) else str(v)) for p, v in
            pmap.items()}


PARALLELISM_CONF = "retentio.tuning.parallelism"


def default_parallelism(df: DataFrame) -> int:
    """Concurrent fits while tuning: the setting ``retentio.tuning.parallelism``,
    else the cluster's default parallelism (each fit is a distributed job)."""
    spark = df.sparkSession
    return max(1, int(spark.conf.get(PARALLELISM_CONF, str(spark.sparkContext.defaultParallelism))))


def _side_by_side(spark: SparkSession, calls: Sequence[Callable], parallelism: int) -> list:
    """The calls' results, in order; at most ``parallelism`` run at a time."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda call: call()), calls))


@dataclass
class _Fold:
    train: DataFrame
    check: DataFrame
    share: float  # of all rows that the fold's training part has
    rows: int  # of the training part

    def few_tasks(self, part: DataFrame) -> DataFrame:
        """Either part in tasks of about ``ROWS_PER_TASK`` rows, counted by the larger training part; never in more tasks."""
        return part.coalesce(max(1, -(-self.rows // ROWS_PER_TASK)))

    def params(self, params: dict) -> dict:
        """A candidate's parameters for this fold: regParam is 1 / (C rows), so fewer rows need more of it."""
        return {p: v / self.share if p.name == "regParam" else v for p, v in params.items()}


def encoded_folds(pipeline: Pipeline, train: DataFrame, label: str, key: str = "customer_id",
                  folds: int = 5) -> list[_Fold]:
    """Per fold: encoders fitted on the other folds, both parts encoded and written once."""
    pre = Pipeline(stages=pipeline.getStages()[:-1])
    keep = [c for c in (label, "w_balanced", "w_one", key) if c in train.columns]

    def one(f: int) -> _Fold:
        model = pre.fit(train.where(F.col("fold") != f))
        coded = cut_lineage(model.transform(train).select(*keep, "fold", "features"))
        n, rows = coded.agg(F.count_if(F.col("fold") != f), F.count("*")).first()
        return _Fold(coded.where(F.col("fold") != f), coded.where(F.col("fold") == f), max(1, n) / max(1, rows), n)

    return _side_by_side(train.sparkSession, [functools.partial(one, f) for f in range(folds)], folds)


def cross_validate(clf: Estimator, grid: list, folds: list[_Fold], label: str,
                   parallelism: int, by_share: bool = False) -> list[float]:
    """Mean recall of class 1 per candidate; fits of all folds run side by side.

    Candidates that one fit can judge share it: forests by :func:`forest.nested_cv`,
    Gaussian Bayes models by their class moments.  Parameters hold as given, as
    in Spark's ``CrossValidator``, or with ``by_share`` as each fold's rows want.
    """
    if isinstance(clf, RandomForestClassifier):
        return forest.nested_cv(clf, grid, folds, label, parallelism)
    evaluator = recall_evaluator(label)
    if isinstance(clf, GaussianBayes):
        def all_smoothings(fold: _Fold) -> list[float]:
            moments = clf.moments(fold.few_tasks(fold.train))
            return [evaluator.evaluate(clf.smoothed(moments, params.get(clf.varSmoothing, clf.getOrDefault(clf.varSmoothing)))
                                       .transform(fold.few_tasks(fold.check))) for params in grid]
        with ThreadPoolExecutor(parallelism) as pool:
            got = list(pool.map(inheritable_thread_target(folds[0].train.sparkSession)(all_smoothings), folds))
        return [sum(scores) / len(folds) for scores in zip(*got)]

    def one(task: tuple[_Fold, dict]) -> float:
        fold, params = task
        model = clf.fit(fold.few_tasks(fold.train), fold.params(params) if by_share else params)
        return evaluator.evaluate(model.transform(fold.few_tasks(fold.check)))

    tasks = [(fold, params) for params in grid for fold in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        got = list(pool.map(inheritable_thread_target(folds[0].train.sparkSession)(one), tasks))
    return [sum(got[i:i + len(folds)]) / len(folds) for i in range(0, len(got), len(folds))]


def out_of_fold(clf: Estimator, params: dict, folds: list[_Fold], label: str, key: str) -> DataFrame:
    """``(key, label, proba)``: every row judged by a model that has not seen its fold."""
    def one(f: _Fold) -> DataFrame:
        part = f.train if isinstance(clf, RandomForestClassifier) else f.few_tasks(f.train)
        return with_probability(clf.fit(part, f.params(params)).transform(f.check)).select(
            key, F.col(label).cast("int").alias("label"), "proba")

    parts = _side_by_side(folds[0].train.sparkSession, [functools.partial(one, f) for f in folds], len(folds))
    return cut_lineage(functools.reduce(DataFrame.unionByName, parts))


def tune(name: str, pipeline: Pipeline, grid: list, train: DataFrame, label: str = "label",
         parallelism: int | None = None, checkpoint: bool = True, key: str | None = None,
         encoded: Callable[[], list[_Fold]] | None = None) -> TuneResult:
    """Grid search over 5 stratified folds (column ``fold``) by recall of class 1.

    The encoders do not depend on the candidate, so they are fitted and applied
    once per fold and only the classifier is fitted per candidate.  The best
    candidate is refitted with its encoders on all training rows.  A failing
    model is recorded and skipped.  The training frame is written first unless
    the caller already did (``checkpoint=False``).  With ``key`` the best
    candidate's out-of-fold predictions are kept (for voting).  ``encoded``
    gives the encoded folds when models share them.
    """
    try:
        if checkpoint:
            train = cut_lineage(train)
        grid = grid or [{}]
        clf = pipeline.getStages()[-1]
        folds = encoded() if encoded else encoded_folds(pipeline, train, label, key or "customer_id")
        scores = cross_validate(clf, grid, folds, label, parallelism or default_parallelism(train), by_share=True)
        best = max(range(len(grid)), key=lambda i: scores[i])
        calls = [lambda: pipeline.fit(train, grid[best])]
        if key:
            calls.append(lambda: out_of_fold(clf, grid[best], folds, label, key))
        model, *oof = _side_by_side(train.sparkSession, calls, len(calls))
        return TuneResult(name, model, _param_dict(grid[best]), scores[best], oof=oof[0] if oof else None)
    except Exception as e:  # noqa: BLE001 - recorded, model skipped
        return TuneResult(name, None, {}, None, f"{type(e).__name__}: {e}")


def baseline_cv(pipelines: Mapping[str, Pipeline], data: DataFrame, label: str = "label",
                checkpoint: bool = True) -> float:
    """Mean 5-fold recall of the untuned logistic pipeline on ALL rows
    (``data`` is written first unless ``checkpoint=False``)."""
    pipe = pipelines["LogisticRegression"]
    data = cut_lineage(data) if checkpoint else data
    return cross_validate(pipe.getStages()[-1], [{}], encoded_folds(pipe, data, label), label,
                          default_parallelism(data))[0]


def with_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("proba", vector_to_array("probability")[1])


def predictions(model: PipelineModel, df: DataFrame, name: str, key: str = "customer_id",
                label: str = "label") -> DataFrame:
    """Long prediction table ``(model, key, label, proba, prediction)``."""
    return with_probability(model.transform(df)).select(
        F.lit(name).alias("model"), key, F.col(label).cast("int").alias("label"), "proba",
        F.col("prediction").cast("int").alias("prediction"))


def evaluate(pred: DataFrame) -> DataFrame:
    """recall, precision, accuracy, F1, ROC-AUC of one model's predictions."""
    return decision.eval_metrics(pred, label="label", proba="proba", pred="prediction")


def feature_importance(model: PipelineModel, names: Sequence[str], top: int = 4
                       ) -> list[tuple[str, float]]:
    """Top features: importances for trees, |coefficient| (sign kept) for linear."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients"):
        vals = clf.coefficients.toArray().tolist()
    else:
        return []
    pairs = list(zip(names, vals))
    pairs.sort(key=lambda kv: -abs(kv[1]))
    return pairs[:top]


def compare_models(train: DataFrame, test: DataFrame, roles: FeatureRoles,
                   label: str = "label", key: str = "customer_id", full_grid: bool = True,
                   names: Sequence[str] | None = None, parallelism: int | None = None,
                   metric: str = "recall"
                   ) -> tuple[DataFrame, DataFrame, dict[str, TuneResult]]:
    """Tune every candidate, evaluate on test, rank by ``metric`` (recall,
    precision, accuracy, f1 or roc_auc) then F1.

    Returns ``(metrics, predictions, tuned)``: ``metrics`` has one row per
    model with its best parameters (a map) and test metrics, ranked;
    ``predictions`` is the long ``(model, key, label, proba, prediction)``
    table over the test rows (never arrays in cells).
    """
    spark = train.sparkSession
    pipes = model_pipelines(roles, label, names=names)
    train = cut_lineage(add_class_weights(train, label))
    n_train = train.count()
    grids = param_grids(pipes, n_train, full=full_grid)
    with ThreadPoolExecutor(1 + len(pipes)) as pool:
        thread = inheritable_thread_target(spark)
        # the models differ in their last stage only, so one encoding serves all
        encoded = pool.submit(thread(encoded_folds), next(iter(pipes.values())), train, label, key).result
        tuning = {n: pool.submit(thread(tune), n, p, grids[n], train, label, parallelism, checkpoint=False, key=key,
                                 encoded=encoded) for n, p in pipes.items()}
        tuned = {n: t.result() for n, t in tuning.items()}
    fitted = {n: r for n, r in tuned.items() if r.model is not None}
    if not fitted:
        raise RuntimeError(f"no model could be fitted: { {n: r.error for n, r in tuned.items()} }")
    if len(fitted) > 1:
        fitted[VOTING] = tuned[VOTING] = _tune_voting(fitted, key, metric)
    # predicted once, written, and evaluated from the table
    pred_all = cut_lineage(functools.reduce(DataFrame.unionByName, [
        predictions(r.model, test, n, key, label) for n, r in fitted.items()]))
    measured = dict(zip(fitted, _side_by_side(spark, [
        lambda n=n: evaluate(pred_all.where(F.col("model") == n)).first() for n in fitted], len(fitted))))
    rows = []
    for name, r in tuned.items():
        if r.model is None:
            rows.append((name, json.dumps({"error": r.error}), None, None, None, None, None,
                         None, None))
            continue
        m = measured[name]
        top = [] if name == VOTING else feature_importance(r.model, slot_names(r.model, roles))
        rows.append((name, json.dumps(r.params, sort_keys=True), r.cv_metric, m.recall,
                     m.precision, m.accuracy, m.f1, m.roc_auc,
                     json.dumps([[a, round(b, 6)] for a, b in top])))
    metrics = spark.createDataFrame(
        rows, "model string, params string, cv_recall double, recall double, "
              "precision double, accuracy double, f1 double, roc_auc double, "
              "top_features string")
    if metric not in ("recall", "precision", "accuracy", "f1", "roc_auc"):
        raise ValueError("metric must be recall, precision, accuracy, f1 or roc_auc")
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col("f1").desc_nulls_last(),
                       F.col("model"))
    metrics = metrics.withColumn("rank", F.row_number().over(w))  # one row per model
    return metrics, pred_all, tuned


VOTING = "VotingClassifier"


def _tune_voting(fitted: Mapping[str, TuneResult], key: str, metric: str) -> TuneResult:
    """Soft vote of the tuned models, weighted by what does best on out-of-fold predictions."""
    names = list(fitted)
    long = functools.reduce(DataFrame.unionByName, [
        r.oof.select(F.lit(n).alias("model"), "*") for n, r in fitted.items()])
    best = ensemble.soft_vote(long, names, key=key, label="label", proba="proba",
                              metric=metric if metric in ensemble.METRICS else "recall"
                              ).where("rank = 1").first()
    weights = [float(w) for w in best["weights"].split(",")]
    return TuneResult(VOTING, VotingModel({n: r.model for n, r in fitted.items()}, weights),
                      {"weights": best["weights"], "models": ",".join(names)}, best["recall"])


class VotingModel:
    """Weighted mean of several fitted models' probabilities; saved and loaded as a folder."""

    def __init__(self, models: Mapping[str, PipelineModel], weights: Sequence[float]):
        self.models, self.weights = dict(models), list(weights)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, model in self.models.items():
            out = with_probability(model.transform(out)).select(
                *out.columns, F.col("proba").alias(name))
        p = ensemble.weighted_vote(list(self.models), self.weights)
        return (out.withColumn("_p", p).drop(*self.models)
                .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/members/{name}")
        spark.createDataFrame([(list(self.models), self.weights)],
                              "names array<string>, weights array<double>").coalesce(1).write.mode(
            "overwrite").json(f"{path}/vote")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VotingModel":
        row = spark.read.schema("names array<string>, weights array<double>").json(
            f"{path}/vote").first()  # one row
        return cls({n: PipelineModel.load(f"{path}/members/{n}") for n in row["names"]}, row["weights"])


def is_saved(spark: SparkSession, path: str) -> bool:
    """Whether a model was saved under ``path``.  Only a missing path counts as
    not saved; any other error (permissions, network, damage) is raised."""
    try:
        spark.read.text(f"{path}/metadata")
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def deploy(pipeline: Pipeline, data: DataFrame, path: str, overwrite: bool = False
           ) -> PipelineModel:
    """Refit on all rows and save; load the saved model when present."""
    if not overwrite and is_saved(data.sparkSession, path):
        return PipelineModel.load(path)
    model = pipeline.fit(data)
    model.write().overwrite().save(path)
    return model


def score_with_model(model: PipelineModel, df: DataFrame, threshold: float,
                     key: str = "customer_id") -> DataFrame:
    """Churn probability from the model; flag = probability >= threshold."""
    scored = with_probability(model.transform(df)).withColumnRenamed("proba",
                                                                     "churn_probability")
    keep = [c for c in df.columns] + ["churn_probability"]
    return decision.score(scored.select(*keep), threshold)
