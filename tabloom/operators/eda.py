"""Exploratory statistics: missing, duplicates, outliers, correlation, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.stats import clamp
from tabloom.functions.values import (
    is_numeric_type,
    nulls_unified,
    quoted,
    rounded,
    safe_ratio,
    to_number,
)
from tabloom.operators.profile import (
    IDENTIFIER_NAMES,
    IDENTIFIER_SUFFIXES,
    TARGET_NAMES,
    TARGET_SUFFIXES,
    missing_by_column,
    moments,
)
from tabloom.plans.longform import numeric_long
from tabloom.plans.moments import correlation, pair_moments
from tabloom.plans.quantiles import long_quantiles
from tabloom.plans.sizing import spread

TOTAL = "(all columns)"

# Fence factor, score weights, grade limits, outlier alarm.
FENCE = 1.5
SCORE_WEIGHTS = {"missing": 40, "duplicates": 20, "outliers": 20}
GRADES = [(90, "Excellent"), (75, "Good"), (60, "Fair")]
LOWEST_GRADE = "Needs Attention"
OUTLIER_ALARM = 0.05


def _is_identifier(name: str) -> bool:
    plain = name.strip().lower()
    if plain in TARGET_NAMES or plain.endswith(tuple(TARGET_SUFFIXES)):
        return False
    return plain in IDENTIFIER_NAMES or plain.endswith(tuple(IDENTIFIER_SUFFIXES))


def analysed_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no identifiers."""
    return [
        f.name
        for f in df.schema.fields
        if is_numeric_type(f.dataType) and not _is_identifier(f.name)
    ]


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else analysed_columns(df)


def missing_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column plus one total row, most missing first."""
    per_column = missing_by_column(df, columns)
    total = per_column.agg(
        F.lit(TOTAL).alias("column"),
        F.sum("row_count").alias("row_count"),
        F.sum("missing_count").alias("missing_count"),
        safe_ratio(F.sum("missing_count"), F.sum("row_count")).alias("missing_ratio"),
    )
    both = per_column.unionByName(total)
    return both.orderBy(F.desc("missing_ratio"), "column")


def duplicate_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Repeats of a full row after its first occurrence; missing equals missing."""
    names = list(columns or df.columns)
    rows = nulls_unified(df.select(*[quoted(c) for c in names]))
    copies = rows.groupBy(*[quoted(c) for c in names]).agg(F.count("*").alias("_c"))
    total, repeats = F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0))
    return copies.agg(
        total.cast("long").alias("row_count"),
        repeats.cast("long").alias("duplicate_row_count"),
        safe_ratio(repeats, total).alias("duplicate_row_ratio"),
    )


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, quartiles, range and bias-corrected shape per column."""
    names = _columns(df, columns)
    quartiles = long_quantiles(numeric_long(df, names), [0.25, 0.5, 0.75])
    joined = moments(df, names, shape=True).join(F.broadcast(quartiles), "column")
    return joined.select(
        "column",
        "count",
        *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "min")],
        rounded(F.col("q")[0]).alias("q25"),
        rounded(F.col("q")[1]).alias("median"),
        rounded(F.col("q")[2]).alias("q75"),
        *[rounded(F.col(c)).alias(c) for c in ("max", "skewness", "kurtosis")],
    )


def fences(
    long: DataFrame, by: Sequence[str] = ("column",), factor: float = FENCE
) -> DataFrame:
    """(by…, q25, median, q75, lower, upper) of non-missing long values."""
    q = long_quantiles(long, [0.25, 0.5, 0.75], by)
    spread = F.col("q")[2] - F.col("q")[0]
    return q.select(
        *by,
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        (F.col("q")[0] - factor * spread).alias("lower"),
        (F.col("q")[2] + factor * spread).alias("upper"),
    )


def outlier_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """IQR fences with outlier count and share; none below four values."""
    names = _columns(df, columns)
    long = numeric_long(df, names)
    bounds = fences(long)
    v = F.col("value")
    counted = (
        long.join(F.broadcast(bounds), "column")
        .groupBy("column", "lower", "upper")
        .agg(
            F.count("*").alias("n"),
            F.count_if((v < F.col("lower")) | (v > F.col("upper"))).alias("out"),
        )
    )
    enough = F.col("n") >= 4
    return counted.select(
        "column",
        F.when(enough, rounded(F.col("lower"))).alias("lower_bound"),
        F.when(enough, rounded(F.col("upper"))).alias("upper_bound"),
        F.when(enough, F.col("out")).otherwise(F.lit(0)).alias("outlier_count"),
        F.when(enough, safe_ratio(F.col("out"), F.col("n"))).otherwise(F.lit(0.0)).alias(
            "outlier_ratio"
        ),
    ).orderBy(F.desc("outlier_ratio"), "column")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, i, j, correlation) for i < j, pairwise complete, from one scan.

    NULL where a column has no spread among the pair's rows.
    """
    names = list(columns)
    if len(names) < 2:
        empty = "column_a string, column_b string, i int, j int, correlation double"
        return df.sparkSession.createDataFrame([], empty)
    numbers = spread(df.select(*map(quoted, names))).select(
        *[
            to_number(quoted(c), df.schema[c].dataType, strip_commas=True).alias(f"_v{i}")
            for i, c in enumerate(names)
        ]
    )
    listed = F.array(*map(F.lit, names))
    return pair_moments(numbers).select(
        F.get(listed, F.col("i")).alias("column_a"), F.get(listed, F.col("j")).alias("column_b"), "i", "j",
        rounded(correlation()).alias("correlation"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All cells of the symmetric matrix; the diagonal is one."""
    names = _columns(df, columns)
    pairs = correlation_pairs(df, names)
    cell = F.array(
        F.struct(F.col("column_a").alias("x"), F.col("column_b").alias("y"), "correlation"),
        F.struct(F.col("column_b").alias("x"), F.col("column_a").alias("y"), "correlation"),
    )
    both = pairs.select(F.explode(cell).alias("c")).select("c.*")
    one = df.sparkSession.range(1)
    diagonal = one.select(F.explode(F.array(*map(F.lit, names))).alias("x")).select(
        "x", F.col("x").alias("y"), F.lit(1.0).alias("correlation")
    )
    return both.unionByName(diagonal).select(
        F.col("x").alias("column_x"), F.col("y").alias("column_y"), "correlation"
    )


def strongest_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 10
) -> DataFrame:
    pairs = correlation_pairs(df, _columns(df, columns))
    return (
        pairs.where(F.col("correlation").isNotNull())
        .orderBy(F.desc(F.abs("correlation")), "i", "j")
        .limit(k)
        .select("column_a", "column_b", "correlation")
    )


def grade(score: Column) -> Column:
    chain = None
    for limit, name in GRADES:
        test = score >= limit
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit(LOWEST_GRADE))


def quality_inputs(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None
) -> DataFrame:
    """One row with the missing, duplicate, outlier and correlation signals."""
    names = list(columns or df.columns)
    table = df.select(*[quoted(c) for c in names])
    numbers = _columns(table, numeric)
    missing = missing_by_column(table).agg(
        F.sum("missing_count").alias("missing_cell_count"),
        safe_ratio(F.sum("missing_count"), F.sum("row_count")).alias("missing_cell_ratio"),
    )
    duplicates = duplicate_analysis(table)
    high = F.col("outlier_ratio") >= OUTLIER_ALARM
    if numbers:
        outliers = outlier_analysis(table, numbers).agg(
            F.coalesce(F.avg("outlier_ratio"), F.lit(0.0)).alias("mean_outlier_ratio"),
            F.array_join(F.array_sort(F.collect_list(F.when(high, F.col("column")))), ", ").alias(
                "high_outlier_columns"
            ),
        )
        pairs = correlation_pairs(table, numbers).agg(
            F.count("correlation").alias("correlated_pairs")
        )
    else:
        one = df.sparkSession.range(1)
        outliers = one.select(
            F.lit(0.0).alias("mean_outlier_ratio"), F.lit("").alias("high_outlier_columns")
        )
        pairs = one.select(F.lit(0).cast("long").alias("correlated_pairs"))
    return (
        duplicates.crossJoin(F.broadcast(missing))
        .crossJoin(F.broadcast(outliers))
        .crossJoin(F.broadcast(pairs))
    )


def quality_score(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None
) -> DataFrame:
    """Score 0–100 with grade and the rules that fired."""
    signals = quality_inputs(df, columns, numeric)
    raw = (
        F.lit(100.0)
        - F.col("missing_cell_ratio") * SCORE_WEIGHTS["missing"]
        - F.col("duplicate_row_ratio") * SCORE_WEIGHTS["duplicates"]
        - F.col("mean_outlier_ratio") * SCORE_WEIGHTS["outliers"]
    )
    scored = signals.withColumn("quality_score", F.round(clamp(raw, 0.0, 100.0), 2))
    rules = F.array_compact(
        F.array(
            F.when(F.col("missing_cell_ratio") > 0, F.lit("review missing values")),
            F.when(F.col("duplicate_row_count") > 0, F.lit("check duplicate rows")),
            F.when(
                F.col("high_outlier_columns") != "",
                F.concat(F.lit("investigate outliers: "), F.col("high_outlier_columns")),
            ),
            F.when(F.col("correlated_pairs") > 0, F.lit("review correlated features")),
        )
    )
    return scored.select(
        "quality_score",
        grade(F.col("quality_score")).alias("grade"),
        "missing_cell_ratio",
        "duplicate_row_ratio",
        rounded(F.col("mean_outlier_ratio")).alias("mean_outlier_ratio"),
        F.when(F.size(rules) == 0, F.lit("quality looks stable"))
        .otherwise(F.array_join(rules, "; "))
        .alias("recommendations"),
    )


def eda_summary(
    df: DataFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None
) -> DataFrame:
    """All sections as one tidy table (section, column, metric, value)."""
    names = list(columns or df.columns)
    table = df.select(*[quoted(c) for c in names])
    numbers = _columns(table, numeric)

    def melt(section: str, result: DataFrame, key: Column, metrics: Sequence[str]) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return result.select(
            F.lit(section).alias("section"), key.alias("column"), F.explode(cells).alias("m")
        ).select("section", "column", "m.metric", "m.value")

    name = F.col("column")
    parts = [
        melt("missing", missing_analysis(table), name, ["missing_count", "missing_ratio"]),
        melt(
            "duplicates",
            duplicate_analysis(table),
            F.lit(TOTAL),
            ["duplicate_row_count", "duplicate_row_ratio"],
        ),
        melt("quality", quality_score(table, None, numbers), F.lit(TOTAL), ["quality_score"]),
    ]
    if numbers:
        stats = numeric_statistics(table, numbers)
        pair = F.concat_ws(" ~ ", "column_a", "column_b")
        parts += [
            melt("statistics", stats, name, [c for c in stats.columns if c != "column"]),
            melt(
                "outliers",
                outlier_analysis(table, numbers),
                name,
                ["lower_bound", "upper_bound", "outlier_count", "outlier_ratio"],
            ),
            melt("correlation", strongest_pairs(table, numbers), pair, ["correlation"]),
        ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
