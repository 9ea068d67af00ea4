"""Model, experiment, run and job tables, and challenger retraining.

A registry is a DataFrame; a change returns the whole new table, which the
caller writes to a fresh path before pointing readers at it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import rounded
from tabloom.plans.ordering import with_position

MODEL_SCHEMA = (
    "model_id string, dataset_id string, version_id string, target string, task string, "
    "model string, status string, metrics string, path string, created_at timestamp"
)

# States of a model and of a job, and metrics where less is better.
MODEL_STATES = ["candidate", "production", "archived"]
TERMINAL_STATES = ["completed", "failed", "cancelled"]
LOWER_IS_BETTER = ["rmse", "mae"]
SCOPE = ["dataset_id", "target", "task"]


class LifecycleError(ValueError):
    """An unknown model, a bad state, or models that do not belong together."""


def models(
    meta: DataFrame, dataset_id: str | None = None, model_id: str | None = None
) -> DataFrame:
    """Models newest first, of a dataset or by id."""
    kept = meta
    if dataset_id is not None:
        kept = kept.where(F.col("dataset_id") == dataset_id)
    if model_id is not None:
        kept = kept.where(F.col("model_id") == model_id)
    return kept.orderBy(F.desc("created_at"), "model_id")


def append_model(meta: DataFrame, row: Mapping[str, Any]) -> DataFrame:
    fresh = meta.sparkSession.createDataFrame([tuple(row[f.name] for f in meta.schema.fields)], meta.schema)
    return meta.unionByName(fresh)


def set_status(meta: DataFrame, model_id: str, status: str) -> DataFrame:
    """Change one status; a new production model archives the old one of its scope."""
    if status not in MODEL_STATES:
        raise LifecycleError(f"unknown status: {status}")
    chosen = meta.where(F.col("model_id") == model_id).select(*[F.col(c).alias(f"_{c}") for c in SCOPE])
    if chosen.isEmpty():
        raise LifecycleError(f"unknown model: {model_id}")
    joined = meta.crossJoin(F.broadcast(chosen.limit(1)))
    same = F.lit(True)
    for c in SCOPE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    state = F.when(F.col("model_id") == model_id, F.lit(status))
    if status == "production":
        state = state.when(same & (F.col("status") == "production"), F.lit("archived"))
    return joined.withColumn("status", state.otherwise(F.col("status"))).select(*meta.columns)


def promote(meta: DataFrame, model_id: str) -> DataFrame:
    return set_status(meta, model_id, "production")


def production(meta: DataFrame) -> DataFrame:
    """The newest production model of every scope."""
    current = meta.where(F.col("status") == "production")
    return current.groupBy(*SCOPE).agg(
        F.max_by("model_id", F.struct("created_at", "model_id")).alias("model_id"),
        F.max("created_at").alias("created_at"),
    )


def metric_value(metric: str) -> Column:
    return F.get_json_object("metrics", f"$.{metric}").try_cast("double")


def compare(meta: DataFrame, model_ids: Sequence[str] | None, metric: str) -> DataFrame:
    """(rank, model_id, …, value): best first, models without the metric last."""
    kept = meta.where(F.col("model_id").isin(list(model_ids))) if model_ids is not None else meta
    value = F.col("value")
    if metric in LOWER_IS_BETTER:
        group, by = F.when(value.isNull(), 1).otherwise(0), value
    else:  # not a number counts as the largest
        group, by = F.when(value.isNull(), 2).when(F.isnan(value), 0).otherwise(1), -value
    valued = kept.select("model_id", "model", "status", metric_value(metric).alias("value"))
    # A registry can be long: positions come from pieces, no task ranks it alone.
    placed = with_position(valued.withColumn("_group", group).withColumn("_by", by), ["_group", "_by", "model_id"])
    rank = (F.col("_pos") + 1).cast("int").alias("rank")
    return placed.select(rank, "model_id", "model", "status", "value").orderBy("rank")


def recommend(comparison: DataFrame, champion_id: str, challenger_id: str) -> DataFrame:
    """promote, keep_champion or review, by id and not by list order."""
    champion = F.max(F.when(F.col("model_id") == champion_id, F.struct("rank", "value")))
    challenger = F.max(F.when(F.col("model_id") == challenger_id, F.struct("rank", "value")))
    both = comparison.agg(champion.alias("a"), challenger.alias("b"))
    unknown = F.col("a.value").isNull() | F.col("b.value").isNull()
    action = (
        F.when(unknown | (F.col("a.value") == F.col("b.value")), "review")
        .when(F.col("b.rank") < F.col("a.rank"), "promote")
        .otherwise("keep_champion")
    )
    return both.select(
        F.lit(champion_id).alias("champion_id"),
        F.lit(challenger_id).alias("challenger_id"),
        rounded(F.col("a.value")).alias("champion_value"),
        rounded(F.col("b.value")).alias("challenger_value"),
        action.alias("recommendation"),
    )


def retrain_challenger(
    champion: PipelineModel,
    model: str,
    version: DataFrame,
    target: str,
    task: str,
    config,
    key: Sequence[str],
    **options,
) -> DataFrame:
    """Fit the champion's model family on a new version and compare both on its
    test rows: (check and metric columns, recommendation)."""
    from tabloom.operators import supervised as SU
    from tabloom.operators.scoring import contract_check

    checks = contract_check(version, config.columns, champion)
    failed = checks.where(~F.col("passed")).count()
    if failed:
        return checks.select(
            F.lit(None).cast("double").alias("champion_value"),
            F.lit(None).cast("double").alias("challenger_value"),
            F.lit("review").alias("recommendation"),
        ).limit(1)
    run = SU.train(version, target, task, [model], config, key, **options)
    if model not in run.scored:
        raise LifecycleError("the challenger could not be trained")
    metric = "f1_macro" if task == "classification" else "rmse"
    test = run.scored[model].select(*dict.fromkeys([*config.columns, "_y"]))
    old = SU._metrics(SU.predict(champion, test), task).select(F.col(metric).alias("champion_value"))
    new = run.results.select(F.col(metric).alias("challenger_value"))
    gain = F.col("challenger_value") - F.col("champion_value")
    better = gain < 0 if metric in LOWER_IS_BETTER else gain > 0
    return old.crossJoin(F.broadcast(new)).withColumn(
        "recommendation",
        F.when(gain.isNull() | (gain == 0), "review").when(better, "promote").otherwise("keep_champion"),
    )


def promote_challenger(meta: DataFrame, champion_id: str, challenger_id: str) -> DataFrame:
    """Promote only a challenger of the champion's dataset, target and task."""
    scopes = meta.where(F.col("model_id").isin(champion_id, challenger_id)).select("model_id", *SCOPE)
    rows = scopes.collect()  # two models
    if {r["model_id"] for r in rows} != {champion_id, challenger_id}:
        raise LifecycleError("unknown champion or challenger")
    if len({tuple(r[c] for c in SCOPE) for r in rows}) != 1:
        raise LifecycleError("champion and challenger have different scopes")
    return promote(meta, challenger_id)


def experiments(meta: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Model count and best model of every experiment, newest first.

    ``model_results`` is an array of (model, status, value) structs.
    """
    kept = meta if dataset_id is None else meta.where(F.col("dataset_id") == dataset_id)
    usable = F.filter("model_results", lambda m: m["value"].isNotNull())
    lower = F.col("metric").isin(LOWER_IS_BETTER)
    ordered = F.array_sort(
        F.transform(
            usable, lambda m: F.struct(F.when(lower, m["value"]).otherwise(-m["value"]).alias("o"), m["model"].alias("m"))
        )
    )
    return kept.select(
        "experiment_id",
        "dataset_id",
        F.size("model_results").alias("model_count"),
        F.try_element_at(ordered, F.lit(1))["m"].alias("best_model"),
        "created_at",
    ).orderBy(F.desc("created_at"), "experiment_id")


def reference_model(meta: DataFrame) -> DataFrame:
    """Best classifier by macro-F1 (else accuracy); without one, lowest RMSE."""
    classifier = F.col("task") == "classification"
    gain = F.coalesce(metric_value("f1_macro"), metric_value("accuracy"), F.lit(-1.0))
    loss = F.coalesce(metric_value("rmse"), F.lit(float("inf")))
    order = F.struct(
        F.when(classifier, 0).when(F.col("task") == "regression", 1).otherwise(2).alias("kind"),
        F.when(classifier, -gain).otherwise(loss).alias("score"),
        F.col("model_id").alias("id"),
    )
    return meta.agg(F.min_by(F.struct("model_id", "model", "task"), order).alias("m")).select("m.*")


def run_history(steps: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per run: step count, first and last step time, failed steps."""
    history = steps.groupBy("run_id").agg(
        F.count("*").alias("step_count"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("finished_at"),
        F.count_if(F.col("status") == "failed").alias("failed_steps"),
    )
    if errors is None:
        return history
    counts = errors.groupBy("run_id").agg(F.count("*").alias("error_count"))
    return history.join(counts, "run_id", "left").withColumn(
        "error_count", F.coalesce("error_count", F.lit(0))
    )


def job_state(events: DataFrame) -> DataFrame:
    """Latest status, start and finish times, event count and error per job.

    The newest event wins, ties by event id; step events do not set the status.
    """
    moves = F.col("event_type") != "step"
    ended = F.col("status").isin(TERMINAL_STATES) & moves
    newest = F.when(moves, F.struct("created_at", "event_id"))
    return events.groupBy("job_id").agg(
        F.max_by("status", newest).alias("status"),
        F.min(F.when(F.col("event_type") == "running", F.col("created_at"))).alias("started_at"),
        F.max(F.when(ended, F.col("created_at"))).alias("finished_at"),
        F.count("*").alias("event_count"),
        F.max_by("message", F.when(F.col("status") == "failed", F.struct("created_at", "event_id"))).alias("error"),
    )
