"""Queries for lifecycle tables, reports and streams.

Registries are built from the given tables: an order is a model of its
customer's nation segment, a user's events are a job.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import lifecycle as L
from tabloom.operators import report as RP
from tabloom.operators import supervised as SU
from tabloom.operators.features import FeatureConfig
from tabloom.session import shared_folder
from tabloom.streaming import events as ST
from tabloom.workload.eda import QUALITY_COLUMNS, QUALITY_NUMBERS, QUALITY_SELECT, QUALITY_SQL
from tabloom.workload.inputs import (
    DOCUMENT_LABELS_SQL,
    document_labels,
    labelled_documents,
    long_sql,
    table,
)
from tabloom.workload.registry import query


def registry(spark, folder):
    orders = table(spark, folder, "orders")
    task = F.when(F.col("o_orderpriority") < "3", "classification").otherwise("regression")
    name = F.when(F.col("o_orderpriority") < "3", "f1_macro").otherwise("rmse")
    value = F.round(F.col("o_totalprice") / 1000000, 6)
    return orders.select(
        F.concat(F.lit("m"), "o_orderkey").alias("model_id"),
        F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("dataset_id"),
        F.lit("v1").alias("version_id"),
        F.lit("price").alias("target"),
        task.alias("task"),
        F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "production")
        .otherwise("candidate").alias("status"),
        F.concat(F.lit('{"'), name, F.lit('":'), F.format_string("%.6f", value), F.lit("}")).alias("metrics"),
        F.lit(None).cast("string").alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


REGISTRY_SQL = """(SELECT 'm' || o_orderkey AS model_id, 'd' || (o_custkey % 50) AS dataset_id, 'price' AS target,
    CASE WHEN o_orderpriority < '3' THEN 'classification' ELSE 'regression' END AS task, o_orderpriority AS model,
    CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'production' ELSE 'candidate' END AS status,
    round(o_totalprice / 1000000, 6) AS value, o_orderdate AS created_at FROM orders)"""


@query(
    "lc01_models",
    f"""SELECT model_id, model, status, created_at FROM {REGISTRY_SQL} WHERE dataset_id = 'd7'""",
)
def models(spark, folder):
    shown = L.models(registry(spark, folder), "d7")
    return shown.select("model_id", "model", "status", F.col("created_at").cast("timestamp_ntz"))


@query(
    "lc02_promote",
    f"""WITH r AS (SELECT * FROM {REGISTRY_SQL}), c AS (SELECT * FROM r ORDER BY created_at, length(model_id), model_id LIMIT 1)
    SELECT r.model_id, CASE WHEN r.model_id = c.model_id THEN 'production'
      WHEN r.status = 'production' AND r.dataset_id = c.dataset_id AND r.task = c.task THEN 'archived' ELSE r.status END AS status
    FROM r, c""",
)
def promote(spark, folder):
    meta = registry(spark, folder)
    first = meta.orderBy("created_at", F.length("model_id"), "model_id").first()["model_id"]
    return L.promote(meta, first).select("model_id", "status")


@query(
    "lc03_production",
    f"""SELECT dataset_id, target, task, arg_max(model_id, (created_at, model_id)) AS model_id, max(created_at) AS created_at
    FROM {REGISTRY_SQL} WHERE status = 'production' GROUP BY ALL""",
)
def production(spark, folder):
    return L.production(registry(spark, folder)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "lc04_compare",
    f"""SELECT CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, model_id) AS INTEGER) AS rank, model_id, model, status, v AS value
    FROM (SELECT *, CASE WHEN task = 'regression' THEN value END AS v FROM {REGISTRY_SQL})""",
)
def compare(spark, folder):
    return L.compare(registry(spark, folder), None, "rmse")


DOCS = FeatureConfig(numeric=("n_chars",), categorical=("lang", "source"))


@query("lc05_retrain_challenger")
def retrain(spark, folder):
    """Champion of the harmless documents against a challenger on all of them."""
    rows = labelled_documents(spark, folder)
    old = SU.labelled_rows(rows.where("toxic = 0"), "quality", "classification")
    champion = SU.fit_model(SU.prepare(old, DOCS, "classification"), "logistic_regression", "classification")
    return L.retrain_challenger(
        champion, "logistic_regression", rows, "quality", "classification", DOCS, ["doc_id"]
    )


@query(
    "lc05_recommend",
    f"""WITH r AS (SELECT model_id, value, row_number() OVER (ORDER BY value, model_id) AS k FROM {REGISTRY_SQL}
      WHERE task = 'regression')
    SELECT a.model_id AS champion_id, b.model_id AS challenger_id, round(a.value, 4) AS champion_value,
      round(b.value, 4) AS challenger_value, CASE WHEN a.value = b.value THEN 'review' WHEN b.k < a.k THEN 'promote'
      ELSE 'keep_champion' END AS recommendation FROM r a, r b WHERE a.k = 2 AND b.k = 1""",
)
def recommend(spark, folder):
    ranked = L.compare(registry(spark, folder), None, "rmse")
    best = [r["model_id"] for r in ranked.orderBy("rank").limit(2).collect()]
    return L.recommend(ranked, best[1], best[0])


@query(
    "lc06_promote_challenger",
    f"""WITH r AS (SELECT *, dataset_id = 'd7' AND task = 'regression' AS here FROM {REGISTRY_SQL}),
    k AS (SELECT model_id, row_number() OVER (ORDER BY value, model_id) AS k FROM r WHERE here)
    SELECT model_id, CASE WHEN model_id = (SELECT model_id FROM k WHERE k = 1) THEN 'production'
      WHEN here AND status = 'production' THEN 'archived' ELSE status END AS status FROM r""",
)
def promote_challenger(spark, folder):
    """The two best models of one dataset change places in the whole registry."""
    meta = registry(spark, folder)
    scope = meta.where("dataset_id = 'd7' AND task = 'regression'")
    best = [r["model_id"] for r in L.compare(scope, None, "rmse").orderBy("rank").limit(2).collect()]
    return L.promote_challenger(meta, best[1], best[0]).select("model_id", "status")


@query(
    "lc07_experiments",
    f"""SELECT 'e' || dataset_id || task AS experiment_id, dataset_id, count(*)::INTEGER AS model_count,
      arg_min(model_id, (CASE WHEN task = 'regression' THEN value ELSE -value END, model_id)) AS best_model,
      max(created_at) AS created_at FROM {REGISTRY_SQL} GROUP BY dataset_id, task""",
)
def experiments(spark, folder):
    meta = registry(spark, folder)
    value = F.coalesce(L.metric_value("rmse"), L.metric_value("f1_macro"))
    grouped = meta.groupBy("dataset_id", "task").agg(
        F.collect_list(F.struct(F.col("model_id").alias("model"), "status", value.alias("value"))).alias("model_results"),
        F.max("created_at").cast("timestamp_ntz").alias("created_at"),
    )
    return L.experiments(
        grouped.select(
            F.concat(F.lit("e"), "dataset_id", "task").alias("experiment_id"), "dataset_id", "model_results", "created_at",
            F.when(F.col("task") == "regression", "rmse").otherwise("f1_macro").alias("metric"),
        )
    )


@query(
    "lc08_reference_model",
    f"""SELECT model_id, model, task FROM {REGISTRY_SQL} WHERE task = 'classification' ORDER BY value DESC, model_id LIMIT 1""",
)
def reference_model(spark, folder):
    return L.reference_model(registry(spark, folder))


def steps(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("value") > 50, "failed").otherwise("success").alias("status"),
    )


@query(
    "lc09_run_history",
    """SELECT 'run-' || user_id AS run_id, count(*) AS step_count, min(ts) AS started_at, max(ts) AS finished_at,
    count_if(value > 50)::BIGINT AS failed_steps, count_if(value > 90)::BIGINT AS error_count FROM events GROUP BY user_id""",
)
def run_history(spark, folder):
    events = table(spark, folder, "events").where("value > 90")
    errors = events.select(F.concat(F.lit("run-"), "user_id").alias("run_id"))
    return L.run_history(steps(spark, folder), errors)


def job_events(df):
    """Map an event table to job events."""
    status = (
        F.when(F.col("value") > 95, "failed").when(F.col("value") > 80, "completed").otherwise("running")
    )
    kind = F.when(F.col("value") < 30, "step").when(F.col("value") > 80, "finished").otherwise("running")
    return df.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("job_id"),
        kind.alias("event_type"), status.alias("status"),
        F.concat(F.lit("event "), "event_type").alias("message"),
        F.col("ts").alias("created_at"),
    )


JOBS_SQL = """(SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS job_id, ts AS created_at,
    'event ' || event_type AS message,
    CASE WHEN value < 30 THEN 'step' WHEN value > 80 THEN 'finished' ELSE 'running' END AS event_type,
    CASE WHEN value > 95 THEN 'failed' WHEN value > 80 THEN 'completed' ELSE 'running' END AS status FROM events)"""


JOB_STATE_SQL = f"""SELECT job_id, arg_max(status, (created_at, event_id)) FILTER (event_type <> 'step') AS status,
    min(created_at) FILTER (event_type = 'running') AS started_at,
    max(created_at) FILTER (event_type <> 'step' AND status IN ('completed', 'failed')) AS finished_at,
    count(*) AS event_count, arg_max(message, (created_at, event_id)) FILTER (status = 'failed') AS error
    FROM {JOBS_SQL} GROUP BY job_id"""


@query("lc10_job_state", JOB_STATE_SQL)
def job_state(spark, folder):
    return L.job_state(job_events(table(spark, folder, "events")))


@query(
    "lc11_report_quality",
    f"""{QUALITY_SQL}, q AS ({QUALITY_SELECT}),
    m AS (SELECT "column", count(*) - count(value) AS n FROM ({long_sql(DOCUMENT_LABELS_SQL, QUALITY_COLUMNS)}) GROUP BY 1)
    SELECT 'quality' AS section, 'grade' AS key, grade AS value FROM q
    UNION ALL SELECT 'recommendations', 'recommendations', recommendations FROM q
    UNION ALL SELECT 'missing', "column" || '.missing_count', n::VARCHAR FROM m""",
)
def report_quality(spark, folder):
    rows = RP.report_table(document_labels(spark, folder), None, QUALITY_COLUMNS, QUALITY_NUMBERS)
    return rows.where(F.col("section").isin("quality", "recommendations", "missing") & (F.col("key") != "quality_score"))


@query("lc11_report_table")
def report_table(spark, folder):
    return RP.report_table(document_labels(spark, folder), None, QUALITY_COLUMNS, QUALITY_NUMBERS)


@query(
    "lc12_run_analysis",
    """SELECT * FROM (VALUES (0, 'profile', 'completed'), (1, 'eda', 'completed'), (2, 'charts', 'completed'),
    (3, 'train', 'completed'), (4, 'report', 'completed')) t("position", step, status)""",
)
def run_analysis(spark, folder):
    rows = labelled_documents(spark, folder)
    done = RP.run_analysis(rows, ["doc_id"], "quality", "classification", ["logistic_regression"])
    for result in done.tables.values():
        result.count()
    return RP.steps_table(done, rows)


# --- streams ------------------------------------------------------------------


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return ST.read_events(spark, folder, "events.parquet", schema)


@query(
    "st01_follow_events",
    f"""WITH j AS (SELECT *, status IN ('completed', 'failed') AND event_type <> 'step' AS ended FROM {JOBS_SQL}),
    n AS (SELECT *, coalesce(sum(ended::INTEGER) OVER (PARTITION BY job_id ORDER BY created_at, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM j)
    SELECT event_id, job_id, event_type, status, ended AS is_terminal FROM n WHERE closed = 0""",
)
def follow_events(spark, folder):
    """Every event arrives twice and is passed on once, until its job has ended."""
    root = shared_folder(spark)
    once = job_events(_stream(spark, folder))
    once = ST.follow_events(once.unionByName(once))
    kept = ST.drain(once, f"{root}/out", f"{root}/state")
    return kept.select("event_id", "job_id", "event_type", "status", "is_terminal")


@query("st02_follow_job_state", JOB_STATE_SQL)
def follow_job_state(spark, folder):
    root = shared_folder(spark)
    states = ST.follow_job_state(job_events(_stream(spark, folder)))
    return ST.drain_updates(states, "job_id", f"{root}/out", f"{root}/state")
