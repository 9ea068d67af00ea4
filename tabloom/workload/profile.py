"""Queries for the column profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.workload.inputs import (
    DIRTY_SQL,
    DOCUMENT_LABELS_SQL,
    dirty_documents,
    document_labels,
    long_sql,
    numeric_sql,
    table,
)
from tabloom.workload.registry import query

DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
DIRTY_COLUMNS = ["size_text", "day_text", "good", "lang", "source"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_NUMBER = "TRY_CAST(replace(trim(value), ',', '') AS DOUBLE)"
_SHAPE = (
    r"regexp_matches(value, '\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b') "
    r"OR regexp_matches(value, '\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b')"
)
TOKENS_SQL = "('true','false','yes','no','y','n','0','1')"


def types_sql(source: str, columns: list[str], physical: dict[str, str]) -> str:
    """CTE chain ending in ``typed``: the type decision written out in SQL."""
    kinds = ", ".join(
        f"({i}, '{c}', '{physical.get(c, 'text')}')" for i, c in enumerate(columns)
    )
    return f"""
WITH long AS ({long_sql(source, columns)}),
kinds(position, "column", physical) AS (VALUES {kinds}),
facts AS (
  SELECT "column", count(*) AS row_count, count(*) - count(value) AS missing_count,
    count(value) AS present, count(DISTINCT value) AS unique_count,
    count(DISTINCT lower(trim(value))) <= 2
      AND bool_and(lower(trim(value)) IN {TOKENS_SQL}) AS tokens,
    avg(CASE WHEN value IS NULL THEN NULL WHEN {_NUMBER} IS NULL THEN 0.0 ELSE 1.0 END) AS num,
    bool_or({_SHAPE}) AS shaped,
    avg(CASE WHEN value IS NULL THEN NULL
        WHEN TRY_CAST(value AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS dated,
    avg(length(value)) AS mean_length
  FROM long GROUP BY "column"),
typed AS (
  SELECT k.position, f.*, k.physical,
    CASE WHEN present = 0 THEN 'unknown'
      WHEN physical = 'boolean' OR tokens THEN 'boolean'
      WHEN physical = 'numeric' THEN 'numeric'
      WHEN physical = 'datetime' THEN 'datetime'
      WHEN num >= 0.9 THEN 'numeric'
      WHEN shaped AND dated >= 0.8 THEN 'datetime'
      WHEN unique_count <= 30 OR round(unique_count / present, 4) <= 0.35 THEN 'categorical'
      WHEN mean_length >= 40 THEN 'text' ELSE 'categorical' END AS inferred_type
  FROM facts f JOIN kinds k ON f."column" = k."column"),
roles AS (
  SELECT *, CASE
      WHEN "column" IN ('target','label','class','outcome','result','churn','survived','default','is_fraud')
        OR regexp_matches("column", '_(target|label|class|outcome)$') THEN 'target_candidate'
      WHEN "column" IN ('id','uuid','guid') OR regexp_matches("column", '_(id|uuid|guid)$') THEN 'identifier'
      WHEN inferred_type = 'datetime' THEN 'datetime' ELSE 'feature_candidate' END AS semantic_role,
    round(missing_count / row_count, 4) AS missing_ratio,
    round(unique_count / row_count, 4) AS unique_ratio
  FROM typed)
"""


DIRTY_TYPES = types_sql(DIRTY_SQL, ["doc_id", *DIRTY_COLUMNS], {"doc_id": "numeric"})


@query(
    "pr01_missing_by_column",
    f"""SELECT "column", count(*) AS row_count, count(*) - count(value) AS missing_count,
    round((count(*) - count(value)) / count(*), 4) AS missing_ratio
    FROM ({long_sql(DOCUMENT_LABELS_SQL, DOC_COLUMNS)}) GROUP BY "column" """,
)
def missing(spark, folder):
    return P.missing_by_column(document_labels(spark, folder))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "pr02_unique_by_column",
    f"""SELECT "column", count(DISTINCT value) AS unique_count,
    round(count(DISTINCT value) / count(*), 4) AS unique_ratio
    FROM ({long_sql('orders', ORDER_COLUMNS)}) GROUP BY "column" """,
)
def unique(spark, folder):
    return P.unique_by_column(table(spark, folder, "orders"), ORDER_COLUMNS)


@query(
    "pr03_detect_boolean",
    f"""SELECT "column", count(DISTINCT lower(trim(value))) <= 2
    AND bool_and(lower(trim(value)) IN {TOKENS_SQL}) AS is_boolean
    FROM ({long_sql(DIRTY_SQL, DIRTY_COLUMNS)}) GROUP BY "column" """,
)
def boolean(spark, folder):
    return P.detect_boolean(dirty_documents(spark, folder), DIRTY_COLUMNS)


@query(
    "pr04_detect_numeric",
    f"""SELECT "column", round(avg(CASE WHEN {_NUMBER} IS NULL THEN 0.0 ELSE 1.0 END), 4) AS parse_ratio,
    avg(CASE WHEN {_NUMBER} IS NULL THEN 0.0 ELSE 1.0 END) >= 0.9 AS is_numeric
    FROM ({long_sql(DIRTY_SQL, DIRTY_COLUMNS)}) WHERE value IS NOT NULL GROUP BY "column" """,
)
def numeric(spark, folder):
    return P.detect_numeric(dirty_documents(spark, folder), DIRTY_COLUMNS)


@query(
    "pr05_detect_datetime",
    f"""WITH long AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS col, doc_id, {c} AS value FROM {DIRTY_SQL}" for c in DIRTY_COLUMNS)}),
    firsts AS (SELECT * FROM long WHERE value IS NOT NULL)
    SELECT col AS "column",
      round(avg(CASE WHEN TRY_CAST(value AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END), 4) AS parse_ratio,
      bool_or({_SHAPE}) AND
      avg(CASE WHEN TRY_CAST(value AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8 AS is_datetime
    FROM firsts GROUP BY col""",
)
def datetime(spark, folder):
    return P.detect_datetime(dirty_documents(spark, folder), DIRTY_COLUMNS)


@query(
    "pr06_infer_types",
    f"""{DIRTY_TYPES} SELECT "column", CAST(position AS INTEGER) AS position, inferred_type FROM typed""",
)
def types(spark, folder):
    return P.infer_types(dirty_documents(spark, folder))


@query(
    "pr07_infer_roles",
    f"""{DIRTY_TYPES} SELECT "column", CAST(position AS INTEGER) AS position,
    inferred_type, semantic_role FROM roles""",
)
def roles(spark, folder):
    return P.infer_roles(P.infer_types(dirty_documents(spark, folder)))


@query(
    "pr08_sample_values",
    f"""WITH long AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS col, doc_id, CAST({c} AS VARCHAR) AS value FROM {DOCUMENT_LABELS_SQL}"
        for c in DOC_COLUMNS)}),
    firsts AS (SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY doc_id) AS INTEGER) AS rank
      FROM long WHERE value IS NOT NULL)
    SELECT col AS "column", rank, value FROM firsts WHERE rank <= 5""",
)
def samples(spark, folder):
    return P.sample_values(document_labels(spark, folder), ["doc_id"])


@query(
    "pr09_top_values",
    f"""WITH counts AS (SELECT "column" AS col, value, count(*) AS n
      FROM ({long_sql(DOCUMENT_LABELS_SQL, DOC_COLUMNS)}) GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY col
      ORDER BY n DESC, value ASC NULLS LAST) AS INTEGER) AS rank FROM counts)
    SELECT col AS "column", rank, value, n AS count FROM ranked WHERE rank <= 5""",
)
def top(spark, folder):
    return P.top_values(document_labels(spark, folder))


def stats_sql(source: str) -> str:
    return f"""SELECT "column", round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
    round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25,
    round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75,
    round(max(value), 4) AS max FROM ({source}) GROUP BY "column" """


@query("pr10_numeric_stats", stats_sql(numeric_sql("lineitem", LINE_NUMBERS)))
def stats(spark, folder):
    return P.numeric_stats(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "pr11_datetime_stats",
    """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders""",
)
def spans(spark, folder):
    return P.datetime_stats(table(spark, folder, "orders"), ["o_orderdate"])


@query(
    "pr12_profile_columns",
    f"""{DIRTY_TYPES},
    nums AS ({stats_sql(f'''SELECT "column", {_NUMBER} AS value FROM long
      WHERE {_NUMBER} IS NOT NULL''')}),
    spans AS (SELECT "column", min(TRY_CAST(value AS TIMESTAMP)) AS first_date,
      max(TRY_CAST(value AS TIMESTAMP)) AS last_date FROM long GROUP BY "column"),
    keyed AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS col, doc_id, CAST({c} AS VARCHAR) AS value FROM {DIRTY_SQL}"
        for c in ["doc_id", *DIRTY_COLUMNS])}),
    firsts AS (SELECT col, string_agg(value, '|' ORDER BY r) AS samples FROM (
      SELECT *, row_number() OVER (PARTITION BY col ORDER BY doc_id) AS r
      FROM keyed WHERE value IS NOT NULL) WHERE r <= 5 GROUP BY col),
    tops AS (SELECT col, string_agg(coalesce(value, 'null') || '=' || n, '|' ORDER BY r) AS top FROM (
      SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value ASC NULLS LAST) AS r FROM (
        SELECT col, value, count(*) AS n FROM keyed GROUP BY ALL)) WHERE r <= 5 GROUP BY col)
    SELECT t."column", inferred_type, semantic_role, missing_count, missing_ratio, unique_count,
      unique_ratio, samples, top,
      CASE WHEN inferred_type = 'numeric' THEN mean END AS mean,
      CASE WHEN inferred_type = 'numeric' THEN median END AS median,
      CASE WHEN inferred_type = 'datetime' THEN first_date END AS first_date,
      CASE WHEN inferred_type = 'datetime' THEN last_date END AS last_date
    FROM roles t LEFT JOIN nums USING ("column") LEFT JOIN spans USING ("column")
    LEFT JOIN firsts ON t."column" = firsts.col LEFT JOIN tops ON t."column" = tops.col""",
)
def profile(spark, folder):
    full = P.profile_columns(dirty_documents(spark, folder), ["doc_id"])
    return full.select(
        "column", "inferred_type", "semantic_role", "missing_count", "missing_ratio",
        "unique_count", "unique_ratio",
        F.array_join("sample_values", "|").alias("samples"),
        F.array_join(
            F.transform(
                "top_values",
                lambda t: F.concat(F.coalesce(t["value"], F.lit("null")), F.lit("="), t["count"]),
            ),
            "|",
        ).alias("top"),
        "numeric_stats.mean", "numeric_stats.median",
        F.col("datetime_stats.min").alias("first_date"),
        F.col("datetime_stats.max").alias("last_date"),
    )


@query(
    "pr13_schema_summary",
    f"""{DIRTY_TYPES},
    copies AS (SELECT count(*) AS n FROM {DIRTY_SQL} GROUP BY ALL),
    same AS (SELECT size_text, day_text, good, lang, source, count(*) AS n FROM {DIRTY_SQL} GROUP BY ALL)
    SELECT max(row_count) AS row_count, count(*) AS column_count,
      count_if(inferred_type = 'numeric')::BIGINT AS numeric_columns,
      count_if(inferred_type = 'categorical')::BIGINT AS categorical_columns,
      count_if(inferred_type = 'datetime')::BIGINT AS datetime_columns,
      count_if(inferred_type = 'boolean')::BIGINT AS boolean_columns,
      count_if(inferred_type = 'text')::BIGINT AS text_columns,
      count_if(inferred_type = 'unknown')::BIGINT AS unknown_columns,
      sum(missing_count)::BIGINT AS missing_cell_count,
      round(sum(missing_count) / (max(row_count) * count(*)), 4) AS missing_cell_ratio,
      coalesce(string_agg("column", ',' ORDER BY position)
        FILTER (semantic_role = 'target_candidate'), '') AS target_candidates,
      (SELECT sum(n - 1)::BIGINT FROM same) AS duplicate_row_count,
      (SELECT round(sum(n - 1) / sum(n), 4) FROM same) AS duplicate_row_ratio
    FROM roles WHERE "column" <> 'doc_id' """,
)
def summary(spark, folder):
    return P.schema_summary(dirty_documents(spark, folder), DIRTY_COLUMNS)
