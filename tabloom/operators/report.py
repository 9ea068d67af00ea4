"""Report sections and the end-to-end analysis of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted
from tabloom.operators import charts, eda
from tabloom.operators.profile import base_profile
from tabloom.session import cut_lineage

# Sections of a report in their order.
SECTIONS = [
    "overview", "schema", "quality", "statistics", "missing", "outliers", "correlation", "charts",
    "models", "recommendations",
]


def _rows(df: DataFrame, section: str, name: Column, values: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(v).alias("k"), F.col(v).cast("string").alias("v")) for v in values]
    )
    exploded = df.select(name.alias("_n"), F.explode(cells).alias("c"))
    key = F.when(F.col("_n") == "", F.col("c.k")).otherwise(F.concat_ws(".", "_n", "c.k"))
    return exploded.select(F.lit(section).alias("section"), key.alias("key"), F.col("c.v").alias("value"))


def report_table(
    df: DataFrame,
    models: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    numeric: Sequence[str] | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """(section, key, value) rows of the fixed report sections."""
    names = list(columns or df.columns)
    table = df.select(*[quoted(c) for c in names])
    numbers = list(numeric) if numeric is not None else eda.analysed_columns(table)
    known = profile if profile is not None else base_profile(table)
    column, none = F.col("column"), F.lit("")
    score = eda.quality_score(table, None, numbers)
    totals = known.agg(
        F.max("row_count").alias("rows"), F.count("*").alias("columns"),
        F.sum("missing_count").alias("missing_cells"),
    )
    parts = [
        _rows(totals, "overview", none, ["rows", "columns", "missing_cells"]),
        _rows(known, "schema", column, ["inferred_type", "semantic_role"]),
        _rows(score, "quality", none, ["quality_score", "grade"]),
        _rows(eda.missing_by_column(table), "missing", column, ["missing_count"]),
        _rows(
            charts.recommend_charts(known), "charts",
            F.concat_ws(".", "chart", F.col("priority").cast("string")), ["columns"],
        ),
        _rows(score, "recommendations", none, ["recommendations"]),
    ]
    if numbers:
        pair = F.concat_ws(" ~ ", "column_a", "column_b")
        parts += [
            _rows(eda.numeric_statistics(table, numbers), "statistics", column, ["mean", "std", "min", "median", "max"]),
            _rows(eda.outlier_analysis(table, numbers), "outliers", column, ["outlier_count"]),
            _rows(eda.strongest_pairs(table, numbers), "correlation", pair, ["correlation"]),
        ]
    if models is not None:
        parts.append(_rows(models, "models", F.col("model_id"), ["model", "status", "metrics"]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@dataclass
class Analysis:
    """Outputs of the stages that ran, and a warning for each that failed."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    steps: list[tuple[str, str]] = field(default_factory=list)


def run_analysis(
    df: DataFrame,
    key: Sequence[str],
    target: str | None = None,
    task: str = "classification",
    models: Sequence[str] = (),
    skip: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> Analysis:
    """Profile, EDA, charts, training and report over one materialised table.

    A failing stage becomes a warning and the later ones still run.
    """
    from tabloom.operators import supervised as SU
    from tabloom.operators.features import config_from_profile

    names = list(columns or df.columns)
    table = cut_lineage(df.select(*[quoted(c) for c in dict.fromkeys([*key, *names])]))
    shown = table.select(*[quoted(c) for c in names])
    done = Analysis()

    def stage(name: str, build) -> None:
        if name in skip:
            done.steps.append((name, "skipped"))
            return
        try:
            done.tables[name] = build()
            done.steps.append((name, "completed"))
        except Exception as error:
            done.warnings.append(f"{name} failed: {str(error)[:300]}")
            done.steps.append((name, "failed"))

    stage("profile", lambda: cut_lineage(base_profile(shown)))
    profile = done.tables.get("profile")
    stage("eda", lambda: eda.eda_summary(shown))
    stage("charts", lambda: charts.recommend_charts(profile))

    def train() -> DataFrame:
        config = config_from_profile(profile, target, excluded=list(key))
        run = SU.train(table, target, task, models, config, key, weights="auto" if task == "classification" else "none")
        return run.results

    if target and models:
        stage("train", train)
    else:
        done.steps.append(("train", "skipped"))

    def report() -> DataFrame:
        trained = done.tables.get("train")
        listed = None
        if trained is not None:
            metric = "f1_macro" if task == "classification" else "rmse"
            listed = trained.select(
                F.col("model").alias("model_id"), "model", "status", F.col(metric).cast("string").alias("metrics")
            )
        return report_table(shown, listed, profile=profile)

    stage("report", report)
    return done


def steps_table(analysis: Analysis, df: DataFrame) -> DataFrame:
    rows = [(i, name, status) for i, (name, status) in enumerate(analysis.steps)]
    return df.sparkSession.createDataFrame(rows, "position int, step string, status string")
