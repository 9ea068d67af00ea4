"""Queries for exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import eda as E
from tabloom.workload.inputs import (
    DOCUMENT_LABELS_SQL,
    document_labels,
    long_sql,
    numeric_sql,
    table,
)
from tabloom.workload.profile import DOC_COLUMNS, LINE_NUMBERS
from tabloom.workload.registry import query

FLAGS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
LINE_LONG = numeric_sql("lineitem", LINE_NUMBERS)

MISSING_SQL = f"""
  SELECT coalesce("column", '(all columns)') AS "column", count(*) AS row_count,
    count(*) - count(value) AS missing_count,
    round((count(*) - count(value)) / count(*), 4) AS missing_ratio
  FROM ({long_sql(DOCUMENT_LABELS_SQL, DOC_COLUMNS)}) GROUP BY ROLLUP ("column")"""


def outliers_sql(long: str) -> str:
    return f"""
  SELECT v."column", round(any_value(lower), 4) AS lower_bound, round(any_value(upper), 4) AS upper_bound,
    count_if(value < lower OR value > upper)::BIGINT AS outlier_count,
    round(count_if(value < lower OR value > upper) / count(*), 4) AS outlier_ratio
  FROM ({long}) v JOIN (
    SELECT "column", q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
      SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM ({long}) GROUP BY "column")) b ON v."column" = b."column"
  GROUP BY v."column" """


def pairs_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {i} AS i, {j} AS j, "
        f"round(corr({a}, {b}), 4) AS correlation FROM {source}"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    )


def statistics_sql(long: str) -> str:
    return f"""SELECT "column", count(*) AS count, round(avg(value), 4) AS mean,
    round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
    round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median,
    round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max,
    round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis
    FROM ({long}) GROUP BY "column" """


@query("ed01_missing_analysis", MISSING_SQL)
def missing(spark, folder):
    return E.missing_analysis(document_labels(spark, folder))


@query(
    "ed02_duplicate_analysis",
    f"""SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_row_count,
    round(sum(n - 1) / sum(n), 4) AS duplicate_row_ratio
    FROM (SELECT {", ".join(FLAGS)}, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def duplicates(spark, folder):
    return E.duplicate_analysis(table(spark, folder, "lineitem"), FLAGS)


@query(
    "ed02_duplicate_texts",
    """SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_row_count,
    round(sum(n - 1) / sum(n), 4) AS duplicate_row_ratio
    FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)""",
)
def duplicate_texts(spark, folder):
    return E.duplicate_analysis(table(spark, folder, "documents"), ["text", "lang"])


@query("ed03_numeric_statistics", statistics_sql(LINE_LONG))
def statistics(spark, folder):
    return E.numeric_statistics(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query("ed04_outlier_analysis", outliers_sql(LINE_LONG))
def outliers(spark, folder):
    return E.outlier_analysis(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "ed05_correlation_matrix",
    f"""WITH p AS ({pairs_sql("lineitem", LINE_NUMBERS)})
    SELECT column_a AS column_x, column_b AS column_y, correlation FROM p
    UNION ALL SELECT column_b, column_a, correlation FROM p
    UNION ALL SELECT unnest({LINE_NUMBERS}) AS x, unnest({LINE_NUMBERS}), 1.0::DOUBLE""",
)
def correlations(spark, folder):
    return E.correlation_matrix(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "ed06_strongest_pairs",
    f"""SELECT column_a, column_b, correlation FROM ({pairs_sql("lineitem", LINE_NUMBERS)})
    ORDER BY abs(correlation) DESC, i, j LIMIT 3""",
)
def strongest(spark, folder):
    return E.strongest_pairs(table(spark, folder, "lineitem"), LINE_NUMBERS, 3)


QUALITY_COLUMNS = ["lang", "source", "n_chars", "quality", "toxic"]
QUALITY_NUMBERS = ["n_chars", "quality", "toxic"]
QUALITY_LONG = numeric_sql(DOCUMENT_LABELS_SQL, QUALITY_NUMBERS)
QUALITY_SQL = f"""
WITH cells AS (SELECT count(*) - count(value) AS missing_cell_count,
    round((count(*) - count(value)) / count(*), 4) AS missing_cell_ratio
    FROM ({long_sql(DOCUMENT_LABELS_SQL, QUALITY_COLUMNS)})),
copies AS (SELECT sum(n - 1)::BIGINT AS duplicate_row_count,
    round(sum(n - 1) / sum(n), 4) AS duplicate_row_ratio
    FROM (SELECT {", ".join(QUALITY_COLUMNS)}, count(*) AS n FROM {DOCUMENT_LABELS_SQL} GROUP BY ALL)),
outs AS ({outliers_sql(QUALITY_LONG)}),
signals AS (SELECT *, (SELECT avg(outlier_ratio) FROM outs) AS mean_out,
    (SELECT string_agg("column", ', ' ORDER BY "column") FROM outs WHERE outlier_ratio >= 0.05) AS high,
    (SELECT count(correlation) FROM ({pairs_sql(DOCUMENT_LABELS_SQL, QUALITY_NUMBERS)})) AS pairs
    FROM cells, copies),
scored AS (SELECT *, round(greatest(0.0, least(100.0, 100.0 - missing_cell_ratio * 40
    - duplicate_row_ratio * 20 - mean_out * 20)), 2) AS quality_score FROM signals)
"""
QUALITY_SELECT = """
SELECT quality_score, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good'
    WHEN quality_score >= 60 THEN 'Fair' ELSE 'Needs Attention' END AS grade,
  missing_cell_ratio, duplicate_row_ratio, round(mean_out, 4) AS mean_outlier_ratio,
  coalesce(nullif(concat_ws('; ',
    CASE WHEN missing_cell_ratio > 0 THEN 'review missing values' END,
    CASE WHEN duplicate_row_count > 0 THEN 'check duplicate rows' END,
    CASE WHEN high <> '' THEN 'investigate outliers: ' || high END,
    CASE WHEN pairs > 0 THEN 'review correlated features' END), ''), 'quality looks stable') AS recommendations
FROM scored"""


@query("ed07_quality_score", QUALITY_SQL + QUALITY_SELECT)
def quality(spark, folder):
    return E.quality_score(document_labels(spark, folder), QUALITY_COLUMNS, QUALITY_NUMBERS)


def _melt(section: str, source: str, key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS \"column\", '{m}' AS metric, {m}::DOUBLE AS value FROM {source}"
        for m in metrics
    )


SUMMARY_SQL = f"""{QUALITY_SQL},
missing AS (SELECT coalesce("column", '(all columns)') AS "column", count(*) - count(value) AS missing_count,
    round((count(*) - count(value)) / count(*), 4) AS missing_ratio
  FROM ({long_sql(DOCUMENT_LABELS_SQL, QUALITY_COLUMNS)}) GROUP BY ROLLUP ("column")),
stats AS ({statistics_sql(QUALITY_LONG)}),
pairs AS (SELECT column_a || ' ~ ' || column_b AS pair, correlation
  FROM ({pairs_sql(DOCUMENT_LABELS_SQL, QUALITY_NUMBERS)}) WHERE correlation IS NOT NULL)
{_melt("missing", "missing", '"column"', ["missing_count", "missing_ratio"])} UNION ALL
{_melt("duplicates", "copies", "'(all columns)'", ["duplicate_row_count", "duplicate_row_ratio"])} UNION ALL
{_melt("quality", "scored", "'(all columns)'", ["quality_score"])} UNION ALL
{_melt("statistics", "stats", '"column"', ["count", "mean", "std", "min", "q25", "median", "q75", "max",
    "skewness", "kurtosis"])} UNION ALL
{_melt("outliers", "outs", '"column"', ["lower_bound", "upper_bound", "outlier_count", "outlier_ratio"])} UNION ALL
{_melt("correlation", "pairs", "pair", ["correlation"])}
"""


@query("ed08_eda_summary", SUMMARY_SQL)
def summary(spark, folder):
    return E.eda_summary(document_labels(spark, folder), QUALITY_COLUMNS, QUALITY_NUMBERS).select(
        "section", "column", "metric", F.col("value")
    )
