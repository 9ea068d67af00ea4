"""Queries for drift: line items and orders before and after 1998."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import drift as D
from tabloom.session import shared_folder
from tabloom.workload.inputs import table
from tabloom.workload.profile import types_sql
from tabloom.workload.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
LABELS = ["l_returnflag", "l_linestatus"]
CUT = "TIMESTAMP '1998-01-01'"


def _sides(spark, folder):
    """The later side is priced differently and loses some labels, so it drifts."""
    rows = table(spark, folder, "lineitem")
    before = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    columns = [*NUMBERS, *LABELS]
    reference = rows.where(before).select(*columns)
    current = rows.where(~before).select(
        "l_quantity",
        (F.col("l_extendedprice") * 1.5).alias("l_extendedprice"),
        "l_discount",
        F.when(F.col("l_quantity") < 20, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )
    return reference, current


REF_SQL = f"(SELECT {', '.join(NUMBERS + LABELS)} FROM lineitem WHERE l_shipdate < {CUT})"
CUR_SQL = f"""(SELECT l_quantity, l_extendedprice * 1.5 AS l_extendedprice, l_discount,
    CASE WHEN l_quantity < 20 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus
    FROM lineitem WHERE l_shipdate >= {CUT})"""


def categorical_sql(columns: list[str]) -> str:
    """(column, psi, js_distance) over smoothed label shares."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce({c}, '<missing>') AS label, {side} AS side FROM {source}"
        for c in columns
        for side, source in ((0, REF_SQL), (1, CUR_SQL))
    )
    return f"""
  SELECT "column", round(sum((q - p) * ln(q / p)), 4) AS psi,
    round(sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 4) AS js_distance
  FROM (SELECT "column", (r + 1e-6) / sum(r + 1e-6) OVER (PARTITION BY "column") AS p,
      (c + 1e-6) / sum(c + 1e-6) OVER (PARTITION BY "column") AS q
    FROM (SELECT "column", label, count_if(side = 0) AS r, count_if(side = 1) AS c
      FROM ({long}) GROUP BY "column", label)) GROUP BY "column" """


def numeric_psi_sql(c: str) -> str:
    edges = ", ".join(str(i / 10) for i in range(11))
    return f"""
  SELECT '{c}' AS "column", round(sum((q - p) * ln(q / p)), 4) AS psi FROM (
    SELECT (r + 1e-6) / sum(r + 1e-6) OVER () AS p, (k + 1e-6) / sum(k + 1e-6) OVER () AS q FROM (
      SELECT i, count_if(side = 0 AND bin = i) AS r, count_if(side = 1 AND bin = i) AS k
      FROM (SELECT side, len(list_filter(inner_edges, lambda e: e <= v)) AS bin FROM (
          SELECT 0 AS side, {c} AS v FROM {REF_SQL} UNION ALL SELECT 1, {c} FROM {CUR_SQL}),
          (SELECT list_filter(list_distinct(q), lambda e: e > q[1] AND e < q[11]) AS inner_edges
            FROM (SELECT quantile_cont({c}, [{edges}]) AS q FROM {REF_SQL}))) b,
        (SELECT unnest(range(len(list_filter(list_distinct(q), lambda e: e > q[1] AND e < q[11])) + 1)) AS i
          FROM (SELECT quantile_cont({c}, [{edges}]) AS q FROM {REF_SQL})) n
      GROUP BY i))"""


def ks_sql(c: str) -> str:
    return f"""
  SELECT '{c}' AS "column", round(max(abs(f - g)), 4) AS ks_statistic FROM (
    SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS f, sum(k) OVER (ORDER BY v) / sum(k) OVER () AS g FROM (
      SELECT v, count_if(side = 0) AS r, count_if(side = 1) AS k FROM (
        SELECT 0 AS side, {c} AS v FROM {REF_SQL} UNION ALL SELECT 1, {c} FROM {CUR_SQL}) GROUP BY v))"""


PSI_SQL = " UNION ALL ".join(numeric_psi_sql(c) for c in NUMBERS)
KS_SQL = " UNION ALL ".join(ks_sql(c) for c in NUMBERS)
MEANS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT round(avg({c}), 4) FROM {REF_SQL}) AS reference_mean,
    (SELECT round(avg({c}), 4) FROM {CUR_SQL}) AS current_mean"""
    for c in NUMBERS
)
UNIQUE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {REF_SQL}) AS reference_unique,
    (SELECT count(DISTINCT {c}) FROM {CUR_SQL}) AS current_unique"""
    for c in LABELS
)
STATUS = "CASE WHEN psi IS NULL THEN 'warning' WHEN psi >= 0.25 THEN 'drift' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END"
COLUMN_SQL = f"""
  SELECT "column", 'numeric' AS kind, psi, {STATUS} AS status, ks_statistic, NULL::DOUBLE AS js_distance,
    reference_mean, current_mean, NULL::BIGINT AS reference_unique, NULL::BIGINT AS current_unique
  FROM ({PSI_SQL}) JOIN ({KS_SQL}) USING ("column") JOIN ({MEANS_SQL}) USING ("column")
  UNION ALL SELECT "column", 'categorical', psi, {STATUS}, NULL, js_distance, NULL, NULL,
    reference_unique, current_unique
  FROM ({categorical_sql(LABELS)}) JOIN ({UNIQUE_SQL}) USING ("column")"""


_REF_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_CUR_SQL = """(SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderpriority AS o_totalprice, o_orderpriority,
    year(o_orderdate) AS o_year FROM orders)"""
_CUR_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_year"]
_NUMERIC = dict.fromkeys(["o_orderkey", "o_custkey", "o_totalprice", "o_year"], "numeric")


def _kinds_sql(source: str, columns: list[str], physical: dict[str, str]) -> str:
    return f"""({types_sql(source, columns, physical)} SELECT "column" AS c,
      CASE WHEN physical = 'text' THEN inferred_type ELSE physical END AS kind FROM typed)"""


@query(
    "dr01_schema_drift",
    f"""SELECT coalesce(a.c, b.c) AS "column", a.kind AS reference_kind, b.kind AS current_kind,
      CASE WHEN a.kind IS NULL THEN 'added' WHEN b.kind IS NULL THEN 'removed' WHEN a.kind <> b.kind THEN 'type_changed'
        ELSE 'same' END AS change
    FROM {_kinds_sql('orders', _REF_COLUMNS, _NUMERIC)} a
    FULL JOIN {_kinds_sql(_CUR_SQL, _CUR_COLUMNS, {"o_orderkey": "numeric", "o_year": "numeric"})} b ON a.c = b.c""",
)
def schema_drift(spark, folder):
    """A price became a label, a key became text, a column went and one came."""
    orders = table(spark, folder, "orders")
    current = orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_orderpriority").alias("o_totalprice"),
        "o_orderpriority",
        F.year("o_orderdate").alias("o_year"),
    )
    return D.schema_drift(orders.select(*_REF_COLUMNS), current, observed=True)


@query(
    "dr02_drift_kind",
    f"""SELECT "column", kind, FALSE AS boolean_like FROM ({COLUMN_SQL})
    UNION ALL SELECT 'is_small', 'categorical', TRUE""",
)
def kind(spark, folder):
    reference, current = _sides(spark, folder)
    small = (F.col("l_quantity") < 10).cast("int")
    return D.drift_kind(reference.withColumn("is_small", small), current.withColumn("is_small", small))


@query("dr03_psi_numeric", PSI_SQL)
def psi_numeric(spark, folder):
    return D.psi_numeric(*_sides(spark, folder), NUMBERS)


@query("dr04_ks", KS_SQL)
def ks(spark, folder):
    return D.ks(*_sides(spark, folder), NUMBERS)


@query("dr05_mean_shift", MEANS_SQL)
def means(spark, folder):
    return D.mean_shift(*_sides(spark, folder), NUMBERS)


@query(
    "dr06_psi_categorical",
    f"""SELECT "column", psi, reference_unique, current_unique
    FROM ({categorical_sql(LABELS)}) JOIN ({UNIQUE_SQL}) USING ("column")""",
)
def psi_categorical(spark, folder):
    return D.psi_categorical(*_sides(spark, folder), LABELS)


@query("dr07_js_distance", f"""SELECT "column", js_distance FROM ({categorical_sql(LABELS)})""")
def js(spark, folder):
    return D.js_distance(*_sides(spark, folder), LABELS)


@query("dr08_column_drift", COLUMN_SQL)
def column_drift(spark, folder):
    return D.column_drift(*_sides(spark, folder))


@query("dr09_target_drift", f"""SELECT * FROM ({COLUMN_SQL}) WHERE "column" = 'l_returnflag' """)
def target(spark, folder):
    return D.target_drift(*_sides(spark, folder), "l_returnflag")


def _scored(spark, folder):
    rows = table(spark, folder, "lineitem")
    before = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    pair = rows.select(
        before.alias("before"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * F.when(before, 2000.0).otherwise(2100.0)).alias("predicted"),
    )
    return pair.where("before").drop("before"), pair.where("NOT before").drop("before")


def regression_sql(where: str, factor: str) -> str:
    return f"""SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
    1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
    FROM (SELECT l_extendedprice AS y, l_quantity * {factor} AS p FROM lineitem WHERE {where})"""


@query("dr10_prediction_drift")
def prediction_drift(spark, folder):
    from tabloom.workload.supervised import fitted_price_model

    model = fitted_price_model(spark, folder)
    rows = table(spark, folder, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    reference = model.transform(rows.where(F.col("l_shipdate") < cut))
    current = model.transform(rows.where(F.col("l_shipdate") >= cut))
    return D.prediction_drift(reference, current, "prediction")


@query(
    "dr11_performance_drift",
    f"""WITH r AS ({regression_sql(f'l_shipdate < {CUT}', '2000.0')}),
    c AS ({regression_sql(f'l_shipdate >= {CUT}', '2100.0')})
    {" UNION ALL ".join(f'''SELECT '{m}' AS metric, round(r.{m}, 4)::DOUBLE AS reference,
    round(c.{m}, 4)::DOUBLE AS current, round(round(c.{m}, 4) - round(r.{m}, 4), 4)::DOUBLE AS delta FROM r, c'''
    for m in ("mae", "rmse", "r2"))}""",
)
def performance_drift(spark, folder):
    return D.performance_drift(*_scored(spark, folder), "regression")


REPORT_SQL = f"""
  WITH f AS (SELECT count_if(status = 'drift')::BIGINT AS drifted, count_if(status = 'warning')::BIGINT AS warned,
      coalesce(string_agg("column", ',' ORDER BY "column") FILTER (status = 'drift'), '') AS drifted_columns
    FROM ({COLUMN_SQL}) WHERE "column" <> 'l_returnflag'),
  t AS (SELECT status AS target_status FROM ({COLUMN_SQL}) WHERE "column" = 'l_returnflag'),
  s AS (SELECT *, 1::BIGINT AS schema_changes, 30
      + CASE WHEN drifted > 0 THEN least(35, 10 + 5 * drifted) ELSE 0 END + least(15, 3 * warned) AS score FROM f, t)
  SELECT 'drift' AS status, schema_changes, drifted, warned, drifted_columns, target_status,
    NULL::VARCHAR AS prediction_status, NULL::DOUBLE AS worst_delta, least(100, score)::INTEGER AS retrain_score,
    CASE WHEN score >= 50 THEN 'retrain_challenger' WHEN score >= 25 THEN 'review' ELSE 'monitor' END AS action,
    score >= 50 AS retrain_recommended FROM s"""


def _report(spark, folder):
    reference, current = _sides(spark, folder)
    return D.drift_report(reference.withColumn("extra", F.lit(1)), current, "l_returnflag", has_model=True)


@query("dr12_drift_report", REPORT_SQL)
def report(spark, folder):
    return _report(spark, folder)


@query(
    "dr13_drift_history",
    f"""SELECT 'r1' AS report_id, 'lineitem' AS dataset_id, status, drifted, retrain_score FROM ({REPORT_SQL})""",
)
def history(spark, folder):
    path = f"{shared_folder(spark)}/reports"
    D.append_report(_report(spark, folder), path, "lineitem", "r1")
    reports = spark.read.parquet(path)
    return D.drift_history(reports, "lineitem").select(
        "report_id", "dataset_id", "status", "drifted", "retrain_score"
    )
