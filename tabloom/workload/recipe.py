"""Queries for transformation recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import recipe as R
from tabloom.workload.inputs import (
    DIRTY_SQL,
    DOCUMENT_LABELS_SQL,
    dirty_documents,
    document_labels,
    table,
)
from tabloom.workload.registry import query

ORDER_VIEW = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "tr01_drop_columns",
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
)
def drop(spark, folder):
    return R.drop_columns(table(spark, folder, "customer"), ["c_name", "c_mktsegment", "nope"]).table


@query(
    "tr02_rename_columns",
    """SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment
    FROM customer""",
)
def rename(spark, folder):
    rules = [("c_custkey", "customer_id"), ("c_acctbal", "balance"), ("nope", "x")]
    return R.rename_columns(table(spark, folder, "customer"), rules).table


@query(
    "tr03_cast_numeric",
    f"""SELECT doc_id, TRY_CAST(size_text AS DOUBLE) AS size_text FROM {DIRTY_SQL}""",
)
def cast_numeric(spark, folder):
    return R.cast_numeric(dirty_documents(spark, folder).select("doc_id", "size_text"), "size_text")


@query(
    "tr04_cast_datetime",
    f"""SELECT doc_id, TRY_CAST(day_text AS TIMESTAMP) AS day_text FROM {DIRTY_SQL}""",
)
def cast_datetime(spark, folder):
    return R.cast_datetime(dirty_documents(spark, folder).select("doc_id", "day_text"), "day_text")


@query(
    "tr05_cast_string",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
)
def cast_string(spark, folder):
    return R.cast_string(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    "tr06_cast_boolean",
    f"""SELECT doc_id, CASE WHEN good IN ('yes') THEN TRUE WHEN good = 'no' THEN FALSE END AS good,
    CASE quality WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS quality
    FROM {DIRTY_SQL} JOIN {DOCUMENT_LABELS_SQL} USING (doc_id)""",
)
def cast_boolean(spark, folder):
    both = dirty_documents(spark, folder).select("doc_id", "good").join(
        document_labels(spark, folder).select("doc_id", "quality"), "doc_id"
    )
    return R.cast_boolean(R.cast_boolean(both, "good"), "quality")


def _labels(spark, folder):
    return document_labels(spark, folder).select("doc_id", "source", "quality")


def _fill_sql(statistic: str, kind: str) -> str:
    return f"""SELECT doc_id, source, {kind}(coalesce(quality, (SELECT {statistic}
    FROM {DOCUMENT_LABELS_SQL}))) AS quality FROM {DOCUMENT_LABELS_SQL}"""


@query("tr07_fill_mean", f"SELECT doc_id, source, round(quality, 6) AS quality FROM ({_fill_sql('avg(quality)', '')})")
def fill_mean(spark, folder):
    return R.fill_mean(_labels(spark, folder), "quality").withColumn("quality", F.round("quality", 6))


@query("tr08_fill_median", f"SELECT doc_id, source, quality::DOUBLE AS quality FROM ({_fill_sql('quantile_cont(quality, 0.5)', '')})")
def fill_median(spark, folder):
    return R.fill_median(_labels(spark, folder), "quality")


@query(
    "tr09_fill_mode",
    f"""SELECT doc_id, lang, coalesce(source, (SELECT source FROM {DIRTY_SQL} WHERE source IS NOT NULL
      GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)) AS source FROM {DIRTY_SQL}""",
)
def fill_mode(spark, folder):
    return R.fill_mode(dirty_documents(spark, folder).select("doc_id", "lang", "source"), "source")


@query(
    "tr10_fill_constant",
    f"SELECT doc_id, source, coalesce(quality, -1)::INTEGER AS quality FROM {DOCUMENT_LABELS_SQL}",
)
def fill_constant(spark, folder):
    return R.fill_constant(_labels(spark, folder), "quality", -1)


@query(
    "tr11_drop_missing",
    f"SELECT * FROM {DOCUMENT_LABELS_SQL} WHERE quality IS NOT NULL AND toxic IS NOT NULL",
)
def drop_missing(spark, folder):
    return R.drop_missing(document_labels(spark, folder), ["quality", "toxic"])


@query("tr12_drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def drop_duplicates(spark, folder):
    return R.drop_duplicates(table(spark, folder, "documents").select("text", "lang"))


CLIP_SQL = """
  b AS (SELECT q1 - f * (q3 - q1) AS lo, q3 + f * (q3 - q1) AS hi, q3 > q1 AS ok FROM (
    SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, {f} AS f FROM {t}))"""


@query(
    "tr13_iqr_clip",
    f"""WITH {CLIP_SQL.format(c='l_extendedprice', t='lineitem', f=0.5)}
    SELECT l_orderkey, l_linenumber, round(greatest(lo, least(hi, l_extendedprice)), 4) AS l_extendedprice
    FROM lineitem, b""",
)
def clip(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    clipped = R.iqr_clip(rows, [R.Clip("l_extendedprice", 0.5)])
    return clipped.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "tr14_datetime_parts",
    """SELECT o_orderkey, o_orderdate, year(o_orderdate)::INTEGER AS o_orderdate_year,
    month(o_orderdate)::INTEGER AS o_orderdate_month, day(o_orderdate)::INTEGER AS o_orderdate_day,
    (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dayofweek FROM orders""",
)
def parts(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return R.datetime_parts(rows, "o_orderdate", ["year", "month", "day", "dayofweek", "era"]).table


RECIPE = R.Recipe(
    drop=("lang",),
    rename=(("source", "origin"),),
    cast=(("good", "boolean"), ("day_text", "datetime"), ("size_text", "numeric")),
    fill=(R.Fill("size_text", "median"), R.Fill("origin", "mode")),
    drop_missing=("good",),
    drop_duplicates=True,
    clip=(R.Clip("size_text", 1.5),),
    date_parts=(R.DateParts("day_text", ("year", "month")),),
)

RECIPE_SQL = f"""
WITH cast_step AS (SELECT doc_id, TRY_CAST(size_text AS DOUBLE) AS size_text,
    TRY_CAST(day_text AS TIMESTAMP) AS day_text,
    CASE good WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE END AS good, source AS origin FROM {DIRTY_SQL}),
filled AS (SELECT doc_id, coalesce(size_text, (SELECT quantile_cont(size_text, 0.5) FROM cast_step)) AS size_text,
    day_text, good, coalesce(origin, (SELECT origin FROM cast_step WHERE origin IS NOT NULL
      GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 1)) AS origin FROM cast_step),
kept AS (SELECT DISTINCT * FROM filled WHERE good IS NOT NULL),
{CLIP_SQL.format(c='size_text', t='kept', f=1.5)}
"""


@query(
    "tr15_apply_recipe",
    f"""{RECIPE_SQL} SELECT doc_id, round(CASE WHEN ok THEN greatest(lo, least(hi, size_text))
      ELSE size_text END, 4) AS size_text, day_text, good, origin,
    year(day_text)::INTEGER AS day_text_year, month(day_text)::INTEGER AS day_text_month FROM kept, b""",
)
def recipe(spark, folder):
    result = R.apply_recipe(dirty_documents(spark, folder), RECIPE).table
    return result.withColumn("size_text", F.round("size_text", 4))


@query(
    "tr16_profile_diff",
    f"""{RECIPE_SQL},
    first AS (SELECT count(*) AS n, sum((size_text IS NULL)::INT + (day_text IS NULL)::INT
      + (good IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT)::BIGINT AS m FROM {DIRTY_SQL}),
    last AS (SELECT count(*) AS n, sum((size_text IS NULL)::INT + (day_text IS NULL)::INT
      + (good IS NULL)::INT + (origin IS NULL)::INT)::BIGINT AS m FROM kept)
    SELECT first.n AS before_rows, last.n AS after_rows, last.n - first.n AS row_delta,
      1::BIGINT AS column_delta, last.m - first.m AS missing_delta,
      'origin,day_text_year,day_text_month' AS added_columns, 'lang,source' AS removed_columns
    FROM first, last""",
)
def diff(spark, folder):
    before = dirty_documents(spark, folder)
    return R.profile_diff(before, R.apply_recipe(before, RECIPE).table)


@query(
    "tr17_preview_recipe",
    f"""{RECIPE_SQL} SELECT doc_id, round(CASE WHEN ok THEN greatest(lo, least(hi, size_text))
      ELSE size_text END, 4) AS size_text, good, origin FROM kept, b ORDER BY doc_id LIMIT 20""",
)
def preview(spark, folder):
    shown = R.preview_recipe(dirty_documents(spark, folder), RECIPE, ["doc_id"]).table
    return shown.select("doc_id", F.round("size_text", 4).alias("size_text"), "good", "origin")
