"""Supervised models, cross-validation, training runs and comparison."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted, rounded, to_number
from tabloom.operators import metrics as M
from tabloom.operators.context import infer_task
from tabloom.operators.features import (
    FeatureConfig,
    build_preprocessor,
    feature_names,
    source_column,
)
from tabloom.operators.neighbours import knn_classify, knn_regress
from tabloom.operators.split import SEED, assign_folds, split
from tabloom.operators.tree_cells import Cells, cells_of, forest_regressor
from tabloom.session import cut_lineage

# Least usable rows of a baseline run and of an experiment.
BASELINE_ROWS = 8
EXPERIMENT_ROWS = 12

CLASSES_AT_ONCE = 8
FOLDS_AT_ONCE = 4


class TrainingError(ValueError):
    """Too few rows, an unknown model or no usable label."""


@dataclass(frozen=True)
class LabelStats:
    rows: int
    classes: int
    label_std: float
    features: int


def _logistic(s: LabelStats, seed: int) -> Estimator:
    # Penalty of C = 1 on the summed loss, as Spark averages the loss.
    return LogisticRegression(
        maxIter=1000, tol=1e-8, regParam=1.0 / s.rows, elasticNetParam=0.0, standardization=False
    )


def _one_vs_rest(estimator: Estimator, s: LabelStats) -> Estimator:
    # The classes' models are independent jobs.
    return estimator if s.classes <= 2 else OneVsRest(classifier=estimator, parallelism=min(s.classes, CLASSES_AT_ONCE))


def _least_squares(s: LabelStats, **options) -> Estimator:
    # The normal equations need one features × features matrix on the driver.
    solver = "normal" if s.features <= 4096 else "l-bfgs"
    return LinearRegression(solver=solver, standardization=False, **options)


CLASSIFIERS: dict[str, Callable[[LabelStats, int], Estimator]] = {
    "logistic_regression": _logistic,
    "random_forest_classifier": lambda s, seed: RandomForestClassifier(numTrees=120, maxDepth=8, seed=seed),
    "gbt_classifier": lambda s, seed: _one_vs_rest(GBTClassifier(maxIter=120, maxDepth=3, stepSize=0.1, seed=seed), s),
    "linear_svm": lambda s, seed: _one_vs_rest(LinearSVC(maxIter=200, regParam=1.0 / s.rows), s),
}
REGRESSORS: dict[str, Callable[[LabelStats, int], Estimator]] = {
    "linear_regression": lambda s, seed: _least_squares(s),
    # Spark scales the label by its deviation before it applies the penalty.
    "ridge_regression": lambda s, seed: _least_squares(
        s, regParam=1.0 * s.label_std / s.rows, elasticNetParam=0.0
    ),
    "lasso_regression": lambda s, seed: LinearRegression(
        solver="l-bfgs", regParam=0.01, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9
    ),
    "random_forest_regressor": lambda s, seed: RandomForestRegressor(numTrees=120, maxDepth=8, seed=seed),
    "gbt_regressor": lambda s, seed: GBTRegressor(maxIter=120, maxDepth=3, stepSize=0.1, seed=seed),
    "robust_regression": lambda s, seed: LinearRegression(loss="huber", maxIter=200),
}
# An experiment's settings where they differ from a baseline run's.
EXPERIMENT_PARAMS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"maxIter": 2000},
    "lasso_regression": {"maxIter": 5000},
    "random_forest_classifier": {"numTrees": 200},
    "random_forest_regressor": {"numTrees": 200},
}
NEIGHBOURS = 5
WEIGHTED = {"logistic_regression", "random_forest_classifier", "linear_svm", "gbt_classifier"}
ON_CELLS = {"gbt_classifier", "gbt_regressor", "random_forest_regressor"}


def detect_task(df: DataFrame, target: str | None, rule: str = "baseline") -> DataFrame:
    """(target, task, detail): baseline counts values against n / 10; the
    workbench rule splits classification into binary and multiclass."""
    if target is None:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("target"),
            F.lit("clustering").alias("task"),
            F.lit("clustering").alias("detail"),
        )
    facts = infer_task(df, target)
    task = F.col("task")
    if rule == "baseline":
        many = F.col("unique_count") > F.greatest(F.lit(10.0), F.col("non_null_count") / 10)
        task = F.when((F.col("inferred_type") == "numeric") & many, "regression").otherwise("classification")
    detail = F.when(task == "regression", "regression").when(
        F.col("unique_count") <= 2, "binary_classification"
    ).otherwise("multiclass_classification")
    return facts.select("target", task.alias("task"), detail.alias("detail"))


@dataclass
class Prepared:
    """Label and feature vectors of the usable rows, ready for any model."""

    rows: DataFrame
    preprocessor: PipelineModel
    labels: list[str]
    stats: LabelStats
    names: list[str]


def labelled_rows(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows with a usable target as ``_y``."""
    if task == "classification":
        y = quoted(target).cast("string")
    else:
        y = to_number(quoted(target), df.schema[target].dataType, strip_commas=True)
    return df.withColumn("_y", y).where(F.col("_y").isNotNull())


def prepare(train: DataFrame, config: FeatureConfig, task: str, weights: str = "none") -> Prepared:
    """Fit the preprocessing on training rows that carry ``_y``."""
    preprocessor = build_preprocessor(config).fit(train)
    prepared = preprocessor.transform(train)
    names = feature_names(prepared)
    labels: list[str] = []
    if task == "classification":
        indexer = StringIndexer(
            inputCol="_y", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
        ).fit(train)
        labels = list(indexer.labels)
        prepared = indexer.transform(prepared)
        weight_rows = M.class_weights(train, "_y", weights).select(F.col("label").alias("_y"), "weight")
        prepared = prepared.join(F.broadcast(weight_rows), "_y")  # one row per class
    else:
        prepared = prepared.withColumn("label", F.col("_y")).withColumn("weight", F.lit(1.0))
    rows = cut_lineage(prepared.select("features", "label", "weight"))
    facts = rows.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    stats = LabelStats(facts["n"], len(labels), float(facts["s"] or 0.0), len(names))
    return Prepared(rows, preprocessor, labels, stats, names)


def fit_model(
    prepared: Prepared, name: str, task: str, seed: int = SEED, params: Mapping[str, Any] | None = None
) -> PipelineModel:
    """One fitted pipeline: preprocessing, model and readable prediction.

    ``params`` override settings of the model (of each part, one-versus-rest).
    """
    known = CLASSIFIERS if task == "classification" else REGRESSORS
    if name == NEIGHBOUR_MODELS[task]:
        return NeighbourModel(prepared, task, **(params or {}))
    if name not in known:
        raise TrainingError(f"unknown {task} model: {name}")
    if task == "classification" and len(prepared.labels) < 2:
        raise TrainingError("classification needs two classes")
    estimator = known[name](prepared.stats, seed)
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    inner._set(**(params or {}))
    if name in WEIGHTED and estimator.hasParam("weightCol"):
        estimator = estimator.copy({estimator.getParam("weightCol"): "weight"})
    cells = cells_of(prepared.rows, prepared.stats.rows, params, seed) if name in ON_CELLS else None
    if cells is None:
        stages = [prepared.preprocessor, estimator.fit(prepared.rows)]
    else:
        stages = [PipelineModel(stages=[prepared.preprocessor, cells.bins]), _fit_cells(cells, estimator, name, seed)]
    if task == "classification":
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=prepared.labels))
    return PipelineModel(stages=stages)


def _fit_cells(cells: Cells, estimator: Estimator, name: str, seed: int) -> Model:
    if name == "random_forest_regressor":
        return forest_regressor(cells, estimator, seed)
    merged = cells.merged(name in CLASSIFIERS)
    return estimator.copy({estimator.getParam("weightCol"): "weight"}).fit(merged)


NEIGHBOUR_MODELS = {"classification": "knn_classifier", "regression": "knn_regressor"}


class NeighbourModel:
    """The k nearest training rows decide; used like a fitted pipeline.

    Equal feature vectors get equal answers, so each distinct one is looked up once.
    """

    def __init__(self, prepared: Prepared, task: str, k: int = NEIGHBOURS):
        self.preprocessor, self.task, self.k = prepared.preprocessor, task, k
        label = "label" if task == "classification" else "target"
        value = F.col("label")
        if task == "classification":
            value = F.element_at(F.array(*map(F.lit, prepared.labels)), F.col("label").cast("int") + 1)
        # The prepared rows are a checkpoint, so their numbers stay the same.
        self.rows = prepared.rows.select(
            F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("vec"), value.alias(label)
        )

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.preprocessor.transform(df).withColumn("_vec", vector_to_array("features"))
        ready = ready.withColumn("_vector", F.xxhash64("_vec"))
        asked = cut_lineage(ready.select(F.col("_vector").alias("id"), F.col("_vec").alias("vec")).dropDuplicates(["id"]))
        find = knn_classify if self.task == "classification" else knn_regress
        found = find(self.rows, asked, self.k).withColumnRenamed("query_id", "_vector")
        return ready.join(found, "_vector", "left").drop("_vector", "_vec")


def save_run(run: TrainingRun, root: str, run_id: str, dataset_id: str) -> None:
    """Keep a run: its pipelines, one row per model and one row of the experiment.

    Neighbour models hold their training rows and are not saved; their row has no path.
    """
    kept = {name: f"{root}/pipelines/{run_id}/{name}" for name, p in run.pipelines.items() if isinstance(p, PipelineModel)}
    for name, path in kept.items():
        run.pipelines[name].write().overwrite().save(path)
    spark = run.results.sparkSession
    paths = spark.createDataFrame([(n, p) for n, p in kept.items()], "model string, path string")
    stamped = run.results.join(F.broadcast(paths), "model", "left").select(  # one row per model
        F.concat_ws("-", F.lit(run_id), "model").alias("model_id"), F.lit(run_id).alias("experiment_id"),
        F.lit(dataset_id).alias("dataset_id"), "*", F.lit("candidate").alias("stage"), F.current_timestamp().alias("created_at"),
    )
    stamped.write.mode("append").parquet(f"{root}/models")
    spark.createDataFrame(
        [(run_id, dataset_id, run.task, run.best, len(run.pipelines))],
        "experiment_id string, dataset_id string, task string, best_model string, model_count int",
    ).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/experiments")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` (a label, or a number)."""
    scored = model.transform(df)
    if "predicted" in scored.columns:
        return scored
    return scored.withColumn("predicted", F.col("prediction"))


def _metrics(scored: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    measure = M.classification_metrics if task == "classification" else M.regression_metrics
    return measure(scored, "_y", "predicted", by)


def _area(scored: DataFrame, labels: Sequence[str]) -> float | None:
    """ROC AUC of the second class, or the weighted one-versus-rest mean; None without scores."""
    name = next((c for c in ("probability", "rawPrediction") if c in scored.columns), None)
    if name is None or len(labels) < 2:
        return None
    values = vector_to_array(name)
    if len(labels) == 2:
        rows = scored.select("_y", values[1].alias("_s"))
        return M.roc_auc(rows, "_s", F.col("_y") == labels[1]).first()["roc_auc"]
    columns = {f"_s{i}": values[i] for i in range(len(labels))}
    rows = scored.select("_y", *[v.alias(c) for c, v in columns.items()])
    return M.roc_auc_weighted(rows, list(zip(columns, labels, strict=True)), "_y").first()["roc_auc"]


def _metric_names(task: str) -> list[str]:
    return M.CLASSIFICATION if task == "classification" else M.REGRESSION


def cross_validate(
    df: DataFrame,
    target: str,
    task: str,
    model: str,
    config: FeatureConfig,
    key: Sequence[str],
    folds: int = 5,
    weights: str = "none",
    seed: int = SEED,
) -> DataFrame:
    """(metric, mean, std, folds, higher_is_better); std is the population one.

    Each fold fits on the others; all held-out rows are measured in one job.
    """
    return _measure_folds(prepare_folds(df, target, task, config, key, folds, weights, seed), task, model, seed)


def prepare_folds(
    df: DataFrame, target: str, task: str, config: FeatureConfig, key: Sequence[str], folds: int = 5,
    weights: str = "none", seed: int = SEED,
) -> list[tuple[Prepared, DataFrame]]:
    """Per fold the prepared rows of the others and its own rows; any model can be fitted on them.

    Both hold the features and ``_y`` only.  The folds are independent and prepared side by side.
    """
    kept = [c for c in df.columns if c in {*config.columns, target}]
    needed = [c for c in df.columns if c in {*key, *kept}]
    rows = labelled_rows(df.select(*map(quoted, needed)), target, task)
    placed = cut_lineage(
        assign_folds(rows, key, folds, "_y" if task == "classification" else None, seed).select(
            *map(quoted, kept), "_y", "fold"
        )
    )
    count = placed.agg(F.max("fold").alias("k")).first()["k"] + 1

    def one(fold: int) -> tuple[Prepared, DataFrame]:
        return prepare(placed.where(F.col("fold") != fold), config, task, weights), placed.where(F.col("fold") == fold)

    with ThreadPoolExecutor(max_workers=min(count, FOLDS_AT_ONCE)) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(count)))


def _measure_folds(
    prepared: Sequence[tuple[Prepared, DataFrame]], task: str, model: str, seed: int,
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    held = None
    for ready, own in prepared:
        scored = predict(fit_model(ready, model, task, seed, params), own).select("fold", "_y", "predicted")
        held = scored if held is None else held.unionByName(scored)
    per_fold = M.metric_rows(_metrics(held, task, ["fold"]), _metric_names(task), ["fold"])
    return per_fold.groupBy("metric").agg(
        rounded(F.avg("value")).alias("mean"),
        rounded(F.stddev_pop("value")).alias("std"),
        F.count("*").alias("folds"),
        (~F.col("metric").isin("mae", "rmse")).alias("higher_is_better"),
    )


def feature_importance(model: PipelineModel, names: Sequence[str], k: int = 15) -> DataFrame:
    """(feature, source_column, importance): tree importances or mean |coefficient|."""
    from pyspark.sql import SparkSession

    fitted = model.stages[1]
    if hasattr(fitted, "models"):  # one-versus-rest
        parts = [_weights(m) for m in fitted.models]
        values = [sum(p[i] for p in parts) / len(parts) for i in range(len(names))]
    else:
        values = _weights(fitted)
    rows = [(n, source_column(n), float(v)) for n, v in zip(names, values, strict=True)]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "feature string, source_column string, importance double")
    return (
        table.withColumn("importance", rounded(F.col("importance"), 6))
        .orderBy(F.desc("importance"), "feature")
        .limit(k)
    )


def _weights(fitted) -> list[float]:
    if hasattr(fitted, "featureImportances"):
        return list(fitted.featureImportances.toArray())
    if hasattr(fitted, "coefficientMatrix"):
        return list(abs(fitted.coefficientMatrix.toArray()).mean(axis=0))
    return list(abs(fitted.coefficients.toArray()))


@dataclass
class TrainingRun:
    """Fitted pipelines, tidy results and scored test rows of one run."""

    task: str
    results: DataFrame
    best: str | None
    pipelines: dict[str, PipelineModel] = field(default_factory=dict)
    scored: dict[str, DataFrame] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)


def train(
    df: DataFrame,
    target: str,
    task: str,
    models: Sequence[str],
    config: FeatureConfig,
    key: Sequence[str],
    test_size: float = 0.2,
    weights: str = "none",
    folds: int = 0,
    seed: int = SEED,
    least_rows: int = BASELINE_ROWS,
    parallel: int = 2,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> TrainingRun:
    """Fit every model on one prepared table; a failing model is only a row.

    Folds are cut from the training side alone and prepared once for all models.
    ``params`` override settings by model name.
    """
    spark = df.sparkSession
    needed = [c for c in dict.fromkeys([*key, *config.columns, target]) if c in df.columns]
    rows = labelled_rows(df.select(*[quoted(c) for c in needed]), target, task)
    placed = cut_lineage(split(rows, key, "_y" if task == "classification" else None, test_size, seed))
    if placed.count() < least_rows:
        raise TrainingError(f"fewer than {least_rows} usable rows")
    test = placed.where("is_test")
    learned = placed.where(~F.col("is_test"))
    prepared = prepare(learned, config, task, weights)
    ready = (
        prepare_folds(learned.drop("is_test", "_y"), target, task, config, key, folds, weights, seed) if folds >= 2 else []
    )
    params = params or {}

    def one(name: str):
        start = time.time()
        try:
            model = fit_model(prepared, name, task, seed, params.get(name))
            scored = predict(model, test)
            values = _metrics(scored, task).first().asDict()
            if task == "classification":
                values["roc_auc"] = _area(scored, prepared.labels)
            cv = {}
            if ready:
                measured = _measure_folds(ready, task, name, seed, params.get(name))
                primary = "f1_macro" if task == "classification" else "rmse"
                row = measured.where(F.col("metric") == primary).first()
                cv = {"cv_mean": row["mean"], "cv_std": row["std"]}
            return name, model, scored, {**values, **cv}, time.time() - start, None
        except Exception as error:  # keep the other models
            return name, None, None, {}, time.time() - start, str(error)[:500]

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), models))
    names = _metric_names(task)
    shown = [*names, *(["roc_auc"] if task == "classification" else []), "cv_mean", "cv_std"]
    fields = ", ".join(f"{m} double" for m in shown)
    table = [
        (
            name, task, target, "failed" if error else "trained", error, float(seconds),
            *[None if values.get(m) is None else float(values[m]) for m in shown],
        )
        for name, _, _, values, seconds, error in done
    ]
    results = spark.createDataFrame(
        table,
        f"model string, task string, target string, status string, error string, training_seconds double, {fields}",
    )
    ranked = M.select_best(results, task)
    best = ranked.where(F.col("is_best") & (F.col("status") == "trained")).first()
    return TrainingRun(
        task,
        ranked,
        best["model"] if best else None,
        {name: model for name, model, *_ in done if model is not None},
        {name: scored for name, _, scored, *_ in done if scored is not None},
        prepared.names,
    )


def experiment(df: DataFrame, target: str, task: str, models: Sequence[str], config: FeatureConfig,
               key: Sequence[str], folds: int = 3, **options) -> TrainingRun:
    """A training run with cross-validation, the larger row minimum and larger models."""
    options.setdefault("weights", "auto")
    options.setdefault("params", EXPERIMENT_PARAMS)
    return train(df, target, task, models, config, key, folds=folds, least_rows=EXPERIMENT_ROWS, **options)
