"""Queries for sources, sinks, versions and registries.

Where an operator writes, the query writes the given table to a new shared
folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.recipe import Fill, Recipe
from tabloom.session import shared_folder
from tabloom.sources import registries as G
from tabloom.sources import tables as S
from tabloom.sources import versions as V
from tabloom.workload.inputs import (
    DOCUMENT_LABELS_SQL,
    document_labels,
    table,
)
from tabloom.workload.registry import query


@query(
    "io01_read_csv",
    f"""SELECT doc_id, lang, source, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic
    FROM {DOCUMENT_LABELS_SQL}""",
)
def read_csv(spark, folder):
    path = f"{shared_folder(spark)}/csv"
    S.write_table(document_labels(spark, folder), path, "csv")
    return S.read_csv(spark, path)


@query("io02_validate", "SELECT * FROM customer")
def validate(spark, folder):
    return S.validate(table(spark, folder, "customer"))


@query(
    "io03_preview",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":'
    || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record
    FROM customer ORDER BY c_custkey LIMIT 20""",
)
def preview(spark, folder):
    return S.preview(table(spark, folder, "customer").drop("c_acctbal"), ["c_custkey"])


@query(
    "io04_load_version",
    f"""SELECT doc_id, lang, source, n_chars, coalesce(quality, 0)::INTEGER AS quality, toxic
    FROM {DOCUMENT_LABELS_SQL}""",
)
def load_version(spark, folder):
    root = shared_folder(spark)
    V.save_version(document_labels(spark, folder), root, "docs")
    V.apply_and_save(spark, root, "docs", Recipe(fill=(Fill("quality", "constant", 0),)))
    return V.load_version(spark, root, "docs")


@query(
    "io05_save_version",
    f"""WITH n AS (SELECT count(*) AS rows FROM {DOCUMENT_LABELS_SQL})
    SELECT 'docs' AS dataset_id, 1::INTEGER AS version_index, 'original' AS kind, rows AS row_count,
      6::INTEGER AS column_count, FALSE AS latest FROM n
    UNION ALL SELECT 'docs', 2, 'derived', rows, 5, TRUE FROM n""",
)
def save_version(spark, folder):
    root = shared_folder(spark)
    V.save_version(document_labels(spark, folder), root, "docs")
    V.apply_and_save(spark, root, "docs", Recipe(drop=("lang",)))
    return V.list_versions(V.versions(spark, root), "docs").select(
        "dataset_id", "version_index", "kind", "row_count", "column_count",
        (F.col("version_id") == F.col("latest_version_id")).alias("latest"),
    )


@query("io06_fingerprint")
def fingerprint(spark, folder):
    return S.fingerprint(table(spark, folder, "lineitem"))


@query(
    "io06_fingerprint_order_free",
    "SELECT count(*) AS row_count, TRUE AS same_hash FROM orders",
)
def fingerprint_stable(spark, folder):
    orders = table(spark, folder, "orders")
    one = S.fingerprint(orders)
    two = S.fingerprint(orders.repartition(7, "o_custkey")).toDF("n2", "x2", "s2")
    return one.crossJoin(F.broadcast(two)).select(
        "row_count",
        ((F.col("hash_xor") == F.col("x2")) & (F.col("hash_sum") == F.col("s2"))).alias("same_hash"),
    )


@query(
    "io07_list_datasets",
    """SELECT 'customers' AS dataset_id, 1::BIGINT AS version_count, count(*) AS row_count,
      5::INTEGER AS column_count FROM customer
    UNION ALL SELECT 'orders', 2, count(*), 5 FROM orders""",
)
def list_datasets(spark, folder):
    root = shared_folder(spark)
    V.save_version(table(spark, folder, "customer"), root, "customers")
    V.save_version(table(spark, folder, "orders"), root, "orders")
    V.apply_and_save(spark, root, "orders", Recipe(drop=("o_orderpriority",)))
    return V.list_datasets(V.versions(spark, root)).select(
        "dataset_id", "version_count", "row_count", "column_count"
    )


@query(
    "io08_align",
    """SELECT o_totalprice, o_orderstatus, CAST(NULL AS VARCHAR) AS discount_code FROM orders""",
)
def align(spark, folder):
    return S.align(table(spark, folder, "orders"), ["o_totalprice", "o_orderstatus", "discount_code"])


@query(
    "io09_export_import",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders""",
)
def export_import(spark, folder):
    root, bundle = shared_folder(spark), shared_folder(spark)
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    V.save_version(rows, root, "orders")
    V.export_dataset(spark, root, "orders", bundle)
    V.import_dataset(spark, bundle, root, "orders-copy")
    return V.load_version(spark, root, "orders-copy")


@query(
    "io09_rewrite_ids",
    """SELECT o_orderkey, 'customer-' || o_custkey AS o_custkey FROM orders""",
)
def rewrite_ids(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("old_id"))
    mapping = customers.withColumn("new_id", F.concat(F.lit("customer-"), "old_id"))
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string"))
    return V.rewrite_ids(rows, mapping, ["o_custkey"])


UPSERT_SQL = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE o_orderstatus END AS status
FROM orders"""


@query("io10_upsert", UPSERT_SQL)
def upsert(spark, folder):
    rows = table(spark, folder, "orders")
    keys = ["o_orderkey", "o_custkey"]
    existing = rows.select(*keys, F.col("o_orderstatus").alias("status"))
    incoming = rows.where("o_orderpriority = '1-URGENT'").select(*keys, F.lit("rush").alias("status"))
    return G.upsert(existing, incoming, keys)


@query(
    "io11_missing_artifacts",
    """SELECT 'nation-' || n_nationkey AS ref FROM nation WHERE n_regionkey = 4""",
)
def missing_artifacts(spark, folder):
    root = shared_folder(spark)
    nations = table(spark, folder, "nation")
    nations.where("n_regionkey < 4").write.partitionBy("n_regionkey").parquet(root)
    listing = G.file_listing(spark, f"{root}/*/*.parquet").select(
        F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("path")
    ).distinct()
    references = nations.select(
        F.concat(F.lit("nation-"), "n_nationkey").alias("ref"),
        F.col("n_regionkey").cast("string").alias("path"),
    )
    return G.missing_artifacts(references, listing).select("ref")


def _run_rows(spark, folder):
    """One run record per customer: its orders are the steps and assertions."""
    orders = table(spark, folder, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed")
    step = F.struct(
        F.col("o_orderkey").cast("string").alias("name"),
        state.alias("status"),
        F.lit(1.0).alias("duration_seconds"),
        F.lit(None).cast("string").alias("payload_path"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    check = F.struct(
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("passed").alias("status"),
        F.lit("").alias("expected"), F.lit("").alias("actual"), F.lit("").alias("message"),
    )
    return (
        orders.groupBy("o_custkey")
        .agg(
            F.collect_list(step).alias("steps"),
            F.collect_list(check).alias("assertions"),
            F.max("o_orderdate").cast("timestamp").alias("created_at"),
            F.max(F.col("o_orderstatus") == "F").alias("any_failed"),
        )
        .select(
            F.concat(F.lit("run-"), "o_custkey").alias("run_id"),
            "created_at",
            F.concat(F.lit("suite-"), F.col("o_custkey") % 5).alias("suite"),
            F.lit(None).cast("map<string,string>").alias("metadata"),
            F.when(F.col("any_failed"), "failed").otherwise("passed").alias("status"),
            "steps", "assertions",
            F.lit(None).cast("string").alias("_corrupt_record"),
            F.lit(None).cast("string").alias("file_name"),
        )
    )


RUNS_SQL = """(SELECT 'run-' || o_custkey AS run_id, 'suite-' || (o_custkey % 5) AS suite,
    CASE WHEN bool_or(o_orderstatus = 'F') THEN 'failed' ELSE 'passed' END AS status,
    count(*)::INTEGER AS step_count, count_if(o_orderstatus = 'F')::INTEGER AS failed_steps,
    count(*)::INTEGER AS assertion_count,
    count_if(o_orderpriority = '1-URGENT')::INTEGER AS failed_assertions,
    max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey)"""


@query(
    "io12_run_summaries",
    f"""SELECT run_id, suite, status, step_count, failed_steps, assertion_count, failed_assertions
    FROM {RUNS_SQL}""",
)
def run_summaries(spark, folder):
    return G.summarise_runs(_run_rows(spark, folder)).drop("created_at")


@query(
    "io13_suite_summary",
    f"""SELECT suite, count(*) AS run_count, count_if(status = 'failed')::BIGINT AS failed_runs,
    CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS status,
    max(created_at) AS last_run FROM {RUNS_SQL} GROUP BY suite""",
)
def suite_summary(spark, folder):
    runs = G.summarise_runs(_run_rows(spark, folder))
    return G.suite_summary(runs).withColumn("last_run", F.col("last_run").cast("timestamp_ntz"))
