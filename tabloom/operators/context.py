"""Analysis context: column summaries, quality dimensions, target readiness, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.stats import clamp, sample_skewness
from tabloom.functions.values import null_if_nan, quoted, rounded, safe_ratio, to_number
from tabloom.operators import eda
from tabloom.operators.profile import base_profile
from tabloom.plans.longform import numeric_long
from tabloom.plans.quantiles import long_quantiles

# Weights of the quality dimensions and rule limits.
DIMENSIONS = [
    ("completeness", 0.4),
    ("consistency", 0.2),
    ("type_stability", 0.2),
    ("outlier_stability", 0.2),
]
STATUS = [(90, "excellent"), (75, "good"), (60, "fair")]
LOWEST_STATUS = "poor"
RISK_LIMIT = 75
STRONG_CORRELATION = 0.85
SMALL_TABLE = 100


def _status(score: Column) -> Column:
    chain = F.when(score >= STATUS[0][0], F.lit(STATUS[0][1]))
    for limit, name in STATUS[1:]:
        chain = chain.when(score >= limit, F.lit(name))
    return chain.otherwise(F.lit(LOWEST_STATUS))


def _numeric(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] | None) -> list[str]:
    return list(numeric) if numeric is not None else eda.analysed_columns(df.select(*columns))


def column_summaries(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None
) -> DataFrame:
    """Role confidence, cardinality band, warnings and preprocessing per column."""
    names = list(columns or df.columns)
    profile = base_profile(df, names)
    numbers = _numeric(df, names, numeric)
    if numbers:
        outliers = eda.outlier_analysis(df, numbers).select("column", "outlier_ratio")
        profile = profile.join(F.broadcast(outliers), "column", "left")
    else:
        profile = profile.withColumn("outlier_ratio", F.lit(None).cast("double"))
    kind, role = F.col("inferred_type"), F.col("semantic_role")
    out = F.coalesce("outlier_ratio", F.lit(0.0))
    labelled = kind.isin("categorical", "boolean")
    confidence = (
        F.when(role.isin("identifier", "target_candidate"), 0.98)
        .when(role == "datetime", 0.95)
        .when(kind == "numeric", 0.9)
        .when(labelled, 0.82)
        .when(kind == "text", 0.75)
        .otherwise(0.3)
    )
    band = (
        F.when(F.col("unique_count") <= 2, "binary")
        .when(F.col("unique_count") <= 10, "low")
        .when((F.col("unique_count") <= 50) | (F.col("unique_ratio") <= 0.5), "medium")
        .otherwise("high")
    )
    steps = (
        F.when(role == "identifier", "exclude_from_model")
        .when(role == "target_candidate", "exclude_from_features,validate_target_encoding")
        .when(
            kind == "numeric",
            F.concat(
                F.lit("median_imputer,standard_scaler"),
                F.when(out >= eda.OUTLIER_ALARM, ",robust_scaler_candidate").otherwise(""),
            ),
        )
        .when(labelled, "most_frequent_imputer,one_hot_encoder")
        .when(kind == "datetime", "datetime_feature_extractor")
        .when(kind == "text", "text_vectorizer")
        .otherwise("manual_type_review")
    )
    warnings = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("missing_ratio") >= 0.4, "high missing ratio").when(
                    F.col("missing_ratio") >= 0.1, "moderate missing ratio"
                ),
                F.when(labelled & (F.col("unique_count") > 50), "high cardinality"),
                F.when(kind == "unknown", "type needs review"),
                F.when(out >= eda.OUTLIER_ALARM, "notable outliers"),
            )
        ),
        "; ",
    )
    return profile.select(
        "column",
        "position",
        "inferred_type",
        "semantic_role",
        confidence.alias("role_confidence"),
        "missing_ratio",
        "unique_count",
        "unique_ratio",
        band.alias("cardinality"),
        out.alias("outlier_ratio"),
        steps.alias("preprocessing"),
        warnings.alias("warnings"),
    )


def quality_dimensions(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None
) -> DataFrame:
    """Four weighted dimensions with status, risk flag and the overall score."""
    names = list(columns or df.columns)
    signals = eda.quality_inputs(df, names, _numeric(df, names, numeric))
    unknown = base_profile(df, names).agg(
        (F.count_if(F.col("inferred_type") == "unknown") / F.count("*")).alias("unknown_ratio")
    )
    one = signals.crossJoin(F.broadcast(unknown))
    shares = {
        "completeness": "missing_cell_ratio",
        "consistency": "duplicate_row_ratio",
        "type_stability": "unknown_ratio",
        "outlier_stability": "mean_outlier_ratio",
    }
    scores = {
        key: F.round(clamp(100 * (1 - F.least(F.col(shares[key]), F.lit(1.0))), 0.0, 100.0), 2)
        for key, _ in DIMENSIONS
    }
    overall = F.lit(0.0)
    for key, weight in DIMENSIONS:
        overall = overall + scores[key] * weight
    rows = F.array(
        *[
            F.struct(F.lit(key).alias("dimension"), F.lit(weight).alias("weight"), scores[key].alias("score"))
            for key, weight in DIMENSIONS
        ]
    )
    exploded = one.select(F.explode(rows).alias("r"), F.round(overall, 2).alias("overall_score"))
    return exploded.select(
        "r.*",
        _status(F.col("r.score")).alias("status"),
        (F.col("r.score") < RISK_LIMIT).alias("is_risk"),
        "overall_score",
        eda.grade(F.col("overall_score")).alias("grade"),
    )


def _target_facts(df: DataFrame, target: str) -> DataFrame:
    """(rows, missing, unique) of one column through its value counts."""
    value = null_if_nan(quoted(target), df.schema[target].dataType).cast("string")
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique_count"),
    )


def infer_task(df: DataFrame, target: str | None = None) -> DataFrame:
    """Requested target or the first candidate, with its task.

    A numeric target with more than max(10, 5 % of rows) values is regression.
    """
    profile = base_profile(df, [target] if target else None)
    if target is None:
        profile = profile.where(F.col("semantic_role") == "target_candidate")
    chosen = profile.orderBy("position").limit(1)
    present = F.col("row_count") - F.col("missing_count")
    many = F.col("unique_count") > F.greatest(F.lit(10), F.floor(present * 0.05))
    return chosen.select(
        F.col("column").alias("target"),
        "inferred_type",
        present.alias("non_null_count"),
        "unique_count",
        F.when((F.col("inferred_type") == "numeric") & many, "regression")
        .otherwise("classification")
        .alias("task"),
    )


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """(label, count, ratio) of the non-missing classes."""
    present = df.where(null_if_nan(quoted(target), df.schema[target].dataType).isNotNull())
    counts = present.groupBy(quoted(target).cast("string").alias("label")).agg(
        F.count("*").alias("count")
    )
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(
        "label", "count", safe_ratio(F.col("count"), F.col("_t")).alias("ratio")
    )


def _size_penalty() -> Column:
    return F.when(F.col("rows") < 50, 25).when(F.col("rows") < 200, 10).otherwise(0)


def _size_warning() -> Column:
    return F.when(F.col("rows") < 50, "fewer than 50 rows").when(
        F.col("rows") < 200, "small table"
    )


def target_classification(df: DataFrame, target: str) -> DataFrame:
    """Majority, imbalance and readiness of a class target in one row."""
    classes = target_classes(df, target)
    summary = classes.agg(
        F.count("*").alias("classes"),
        F.min_by("label", F.struct(-F.col("count"), "label")).alias("majority_class"),
        F.max("count").alias("top"),
        F.min("count").alias("least"),
        F.sum("count").alias("non_null_count"),
    )
    one = summary.crossJoin(F.broadcast(_target_facts(df, target)))
    ratio = safe_ratio(F.col("top"), F.col("non_null_count"))
    penalty = (
        safe_ratio(F.col("missing"), F.col("rows")) * 40
        + _size_penalty()
        + F.when(ratio >= 0.8, 25).when(ratio >= 0.65, 10).otherwise(0)
        + F.when(F.col("least") < 5, 20).otherwise(0)
        + F.when(F.col("unique_count") > 20, 15).otherwise(0)
    )
    warnings = F.array_compact(
        F.array(
            _size_warning(),
            F.when(ratio >= 0.8, "severe class imbalance").when(ratio >= 0.65, "moderate class imbalance"),
            F.when(F.col("least") < 5, "a class has fewer than five rows"),
            F.when(F.col("unique_count") > 20, "many classes"),
        )
    )
    return one.select(
        F.lit(target).alias("target"),
        "non_null_count",
        safe_ratio(F.col("missing"), F.col("rows")).alias("missing_ratio"),
        "classes",
        "majority_class",
        ratio.alias("majority_ratio"),
        F.round(F.col("top") / F.col("least"), 4).alias("imbalance_ratio"),
        F.round(clamp(100 - penalty, 0.0, 100.0), 2).alias("readiness_score"),
        F.array_join(warnings, "; ").alias("warnings"),
    )


def target_regression(df: DataFrame, target: str) -> DataFrame:
    """Moments, skewness and readiness of a numeric target in one row."""
    v = to_number(quoted(target), df.schema[target].dataType, strip_commas=True)
    stats = df.select(v.alias("v")).agg(
        F.count("v").alias("non_null_count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        rounded(sample_skewness(F.col("v"))).alias("skewness"),
    )
    median = long_quantiles(numeric_long(df, [target]), [0.5]).select(F.col("q")[0].alias("median"))
    one = stats.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(_target_facts(df, target)))
    skewed = F.coalesce(F.abs("skewness") >= 2, F.lit(False))
    few = F.col("unique_count") < 20
    penalty = (
        safe_ratio(F.col("missing"), F.col("rows")) * 40
        + _size_penalty()
        + F.when(skewed, 10).otherwise(0)
        + F.when(few, 20).otherwise(0)
    )
    warnings = F.array_compact(
        F.array(_size_warning(), F.when(skewed, "strongly skewed"), F.when(few, "few distinct values"))
    )
    return one.select(
        F.lit(target).alias("target"),
        "non_null_count",
        safe_ratio(F.col("missing"), F.col("rows")).alias("missing_ratio"),
        "unique_count",
        *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "min", "median", "max")],
        "skewness",
        F.round(clamp(100 - penalty, 0.0, 100.0), 2).alias("readiness_score"),
        F.array_join(warnings, "; ").alias("warnings"),
    )


def top_issues(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None, k: int = 10
) -> DataFrame:
    """(issue, rank, name, value): worst columns and strongest pairs."""
    names = list(columns or df.columns)
    numbers = _numeric(df, names, numeric)

    def top(issue: str, rows: DataFrame, name: Column, value: str) -> DataFrame:
        few = rows.select(name.alias("name"), F.col(value).alias("value"))
        order = Window.orderBy(F.desc(F.abs("value")), "name")  # one row per column or pair
        return (
            few.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(F.lit(issue).alias("issue"), "rank", "name", "value")
        )

    missing = eda.missing_by_column(df, names).where(F.col("missing_count") > 0)
    result = top("missing", missing, F.col("column"), "missing_ratio")
    if numbers:
        outliers = eda.outlier_analysis(df, numbers).where(F.col("outlier_count") > 0)
        pairs = eda.correlation_pairs(df, numbers).where(F.col("correlation").isNotNull())
        result = result.unionByName(
            top("outliers", outliers, F.col("column"), "outlier_ratio")
        ).unionByName(
            top("correlation", pairs, F.concat_ws(" ~ ", "column_a", "column_b"), "correlation")
        )
    return result


def findings(
    df: DataFrame,
    target: str | None = None,
    task: str = "classification",
    model_count: int = 0,
    columns: Sequence[str] | None = None,
    numeric: Sequence[str] | None = None,
) -> DataFrame:
    """(id, category, severity, evidence) of every rule that fires, worst first."""
    names = list(columns or df.columns)
    numbers = _numeric(df, names, numeric)
    table = df.select(*names)
    summaries = column_summaries(table, names, numbers)

    def rule(rows: DataFrame, name: str, category: str, severity: Column, evidence: Column, when: Column):
        return rows.where(when).select(
            F.lit(name).alias("id"), F.lit(category).alias("category"),
            severity.alias("severity"), evidence.cast("string").alias("evidence"),
        )

    warning, info = F.lit("warning"), F.lit("info")

    def listed(test: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("column")))), ",")

    labelled = F.col("inferred_type").isin("categorical", "boolean")
    by_column = summaries.agg(
        listed(F.col("missing_ratio") >= 0.1).alias("gaps"),
        F.max("missing_ratio").alias("worst_gap"),
        listed(F.col("outlier_ratio") >= eda.OUTLIER_ALARM).alias("outlying"),
        listed(labelled & (F.col("cardinality") == "high")).alias("wide"),
    )
    copies = eda.duplicate_analysis(table)
    parts = [
        rule(copies, "small-sample-size", "modeling", warning, F.col("row_count"), F.col("row_count") < SMALL_TABLE),
        rule(
            by_column, "missing-value-risk", "data_quality",
            F.when(F.col("worst_gap") >= 0.4, "critical").otherwise("warning"),
            F.col("gaps"), F.col("gaps") != "",
        ),
        rule(copies, "duplicate-row-risk", "data_quality", warning,
             F.col("duplicate_row_count"), F.col("duplicate_row_count") > 0),
        rule(by_column, "outlier-risk", "data_quality", warning, F.col("outlying"), F.col("outlying") != ""),
        rule(by_column, "high-cardinality-categories", "schema", warning, F.col("wide"), F.col("wide") != ""),
    ]
    if len(numbers) > 1:
        strong = eda.correlation_pairs(table, numbers).agg(
            F.count_if(F.abs("correlation") >= STRONG_CORRELATION).alias("pairs")
        )
        parts.append(
            rule(strong, "strong-feature-correlation", "relationship", warning, F.col("pairs"), F.col("pairs") > 0)
        )
    one = df.sparkSession.range(1)
    always = F.lit(True)
    if target is None:
        parts.append(rule(one, "target-not-confirmed", "target", info, F.lit(""), always))
    else:
        analysed = (
            target_regression(df, target) if task == "regression" else target_classification(df, target)
        )
        parts.append(
            rule(analysed, "target-readiness-risk", "target", warning, F.col("warnings"), F.col("warnings") != "")
        )
        if model_count == 0:
            parts.append(rule(one, "model-not-trained", "modeling", info, F.lit(target), always))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    order = F.array_position(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.col("severity"))
    return result.withColumn("severity_rank", order.cast("int")).orderBy("severity_rank", "id")


# What to do about each finding.
ACTIONS = {
    "small-sample-size": "cross-validate and treat metrics as preliminary",
    "missing-value-risk": "define imputation or exclusion per column",
    "duplicate-row-risk": "confirm whether repeated rows are valid",
    "outlier-risk": "inspect extremes and compare robust scaling",
    "strong-feature-correlation": "review redundant features",
    "high-cardinality-categories": "group rare categories or exclude the column",
    "target-readiness-risk": "resolve target warnings first",
}


def next_actions(found: DataFrame, has_target: bool, has_models: bool, charts: int, k: int = 8) -> DataFrame:
    """(rank, action): deduplicated, at most k."""
    mapping = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    urgent = found.where(F.col("severity") != "info").select(
        F.col("severity_rank").alias("a"), F.col("id").alias("b"), mapping[F.col("id")].alias("action")
    )
    tail = []
    if not has_target:
        tail.append("confirm the target and task")
    elif not has_models:
        tail.append("train baseline models with cross-validation")
    else:
        tail.append("compare metrics, errors and importances")
    if charts > 0:
        tail.append("review the recommended charts")
    tail.append("use this context as input of later steps")
    rows = F.array(
        *[F.struct(F.lit(9).alias("a"), F.lit(f"{i}").alias("b"), F.lit(t).alias("action")) for i, t in enumerate(tail)]
    )
    closing = found.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    order = Window.orderBy("a", "b")  # a handful of findings
    unique = urgent.unionByName(closing).groupBy("action").agg(F.min(F.struct("a", "b")).alias("k"))
    return (
        unique.select(F.col("k.a").alias("a"), F.col("k.b").alias("b"), "action")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("rank", "action")
    )
