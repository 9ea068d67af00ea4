"""Batch scoring, what-if scenarios, segments and model contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import (
    as_label,
    is_numeric_type,
    null_if_nan,
    quoted,
    rounded,
    to_number,
)
from tabloom.operators import metrics as M
from tabloom.operators.supervised import predict
from tabloom.plans.longform import numeric_long
from tabloom.plans.quantiles import long_quantiles
from tabloom.sources.tables import align


def class_labels(model: PipelineModel) -> list[str]:
    last = model.stages[-1]
    return list(last.getLabels()) if hasattr(last, "getLabels") else []


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``probabilities``: label → probability, four decimals."""
    scored = predict(model, df)
    if "probability" not in scored.columns:
        return scored.withColumn("probabilities", F.lit(None).cast("map<string,double>"))
    values = F.transform(vector_to_array("probability"), lambda p: F.round(p, 4))
    labels = F.array(*map(F.lit, class_labels(model)))
    return scored.withColumn("probabilities", F.map_from_arrays(labels, values))


def scenario_rows(base: DataFrame, scenarios: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Every base row once per scenario, overridden columns replaced.

    The scenarios are literals of the request, so the rows are expanded in
    place without a join.
    """
    columns = sorted({c for s in scenarios for c in s if c != "scenario"})
    unknown = [c for c in columns if c not in base.columns]
    if unknown:
        raise ValueError(f"unknown scenario columns: {', '.join(unknown)}")
    entries = F.array(
        *[
            F.struct(
                F.lit(str(s.get("scenario", f"scenario-{i + 1}"))).alias("scenario"),
                *[F.lit(s.get(c)).cast(base.schema[c].dataType).alias(c) for c in columns],
            )
            for i, s in enumerate(scenarios)
        ]
    )
    rows = base.withColumn("_s", F.explode(entries))
    return rows.select(
        F.col("_s.scenario").alias("scenario"),
        *[F.coalesce(F.col(f"_s.`{c}`"), quoted(c)).alias(c) if c in columns else quoted(c) for c in base.columns],
    )


def what_if(model: PipelineModel, base: DataFrame, scenarios: Sequence[Mapping[str, Any]]) -> DataFrame:
    return predict(model, scenario_rows(base, scenarios))


def labelled(df: DataFrame, feature_columns: Sequence[str], target: str) -> DataFrame:
    """Rows with a target, reduced to the model's features and the target."""
    present = df.where(null_if_nan(quoted(target), df.schema[target].dataType).isNotNull())
    return align(present, [*feature_columns, target])


def segments(scored: DataFrame, column: str, max_bins: int = 5) -> DataFrame:
    """Adds ``segment``: quantile bins of a numeric column with more distinct
    values than bins, else its most frequent values; other rows drop out."""
    data_type = scored.schema[column].dataType
    few = scored.select(quoted(column)).where(quoted(column).isNotNull()).distinct().limit(max_bins + 1)
    if is_numeric_type(data_type) and few.count() > max_bins:
        probabilities = [i / max_bins for i in range(max_bins + 1)]
        q = long_quantiles(numeric_long(scored, [column]), probabilities)
        edges = q.select(F.array_distinct("q").alias("_e"))
        v = to_number(quoted(column), data_type)
        # Right-closed bins; the lowest value belongs to the first one.
        below = F.size(F.filter(F.slice("_e", 2, F.size("_e")), lambda e: e < v))
        index = F.least(below, F.greatest(F.size("_e") - 2, F.lit(0)))
        return (
            scored.crossJoin(F.broadcast(edges))
            .where(v.isNotNull())
            .withColumn("segment", F.concat(F.lit("bin-"), index + 1))
            .drop("_e")
        )
    label = as_label(null_if_nan(quoted(column), data_type), "nan")
    counts = scored.groupBy(label.alias("segment")).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), "segment").limit(max_bins).select("segment")
    return scored.withColumn("segment", label).join(F.broadcast(top), "segment", "left_semi")


def segment_metrics(
    scored: DataFrame, column: str, task: str, max_bins: int = 5,
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """Row count and metrics per segment in one grouped pass."""
    measure = M.classification_metrics if task == "classification" else M.regression_metrics
    return measure(segments(scored, column, max_bins), actual, predicted, ["segment"])


def contract_check(
    df: DataFrame, feature_columns: Sequence[str], model: PipelineModel | None = None,
    schema: Mapping[str, str] | None = None,
) -> DataFrame:
    """(check, passed, detail): required columns, and that an all-missing row scores."""
    spark = df.sparkSession
    missing = [c for c in feature_columns if c not in df.columns]
    rows = [("required_columns", not missing, ",".join(missing))]
    if model is not None:
        kinds = schema or {c: df.schema[c].dataType.simpleString() for c in feature_columns if c in df.columns}
        empty = spark.range(1).select(
            *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in feature_columns]
        )
        try:
            value = predict(model, empty).select("predicted").first()["predicted"]
            rows.append(("empty_row_scores", value is not None, ""))
        except Exception as error:
            rows.append(("empty_row_scores", False, str(error)[:300]))
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def confidence(scored: DataFrame) -> DataFrame:
    """Adds ``confidence``: probability of the predicted class."""
    return scored.withColumn(
        "confidence", F.element_at("probabilities", F.col("predicted"))
    )


def misclassified(
    scored: DataFrame, key: Sequence[str], columns: Sequence[str], k: int = 25,
    actual: str = "actual", predicted: str = "predicted", score: Column | None = None,
) -> DataFrame:
    """First k wrong rows with confidence and a JSON snapshot of the record."""
    wrong = scored.where(quoted(actual).cast("string") != quoted(predicted).cast("string"))
    snapshot = F.to_json(F.struct(*[quoted(c) for c in columns]))
    value = score if score is not None else F.col("confidence")
    return wrong.orderBy(*key).limit(k).select(
        *key, actual, predicted, rounded(value, 6).alias("confidence"), snapshot.alias("record")
    )
