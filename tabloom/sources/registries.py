"""Registry tables and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "record_id string, dataset_id string, secondary_id string, status string, "
    "payload string, created_at timestamp, updated_at timestamp"
)

RUN_SCHEMA = (
    "run_id string, created_at timestamp, suite string, metadata map<string,string>, "
    "status string, "
    "steps array<struct<name:string,status:string,duration_seconds:double,payload_path:string,"
    "error:string,metadata:map<string,string>>>, "
    "assertions array<struct<name:string,status:string,expected:string,actual:string,"
    "message:string>>, _corrupt_record string"
)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming records replace those with the same (composite) key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    tie = F.xxhash64(*[c for c in both.columns if c != "_new"])
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"), tie)
    return (
        both.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") == 1)
        .drop("_r", "_new")
    )


def file_listing(spark: SparkSession, glob: str) -> DataFrame:
    """Paths only; file contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def missing_artifacts(references: DataFrame, listing: DataFrame) -> DataFrame:
    """References whose path no file has."""
    return references.join(listing.select("path"), "path", "left_anti")


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Counts of steps and assertions per run record."""
    steps = F.coalesce("steps", F.array())
    checks = F.coalesce("assertions", F.array())

    def failed(items):
        return F.size(F.filter(items, lambda x: x["status"] == "failed"))

    broken = F.col("_corrupt_record").isNotNull() | F.col("run_id").isNull()
    return runs.select(
        F.coalesce("run_id", "file_name").alias("run_id"),
        "suite",
        "created_at",
        F.when(broken, F.lit("invalid")).otherwise(F.col("status")).alias("status"),
        F.size(steps).alias("step_count"),
        failed(steps).alias("failed_steps"),
        F.size(checks).alias("assertion_count"),
        failed(checks).alias("failed_assertions"),
    )


def run_summaries(spark: SparkSession, glob: str, limit: int | None = None) -> DataFrame:
    """One row per run log, newest first, all or ``limit``; an unreadable file is ``invalid``."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    runs = (
        spark.read.schema(RUN_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(glob)
        .withColumn("file_name", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))
    )
    newest = summarise_runs(runs).orderBy(F.desc_nulls_last("created_at"), "run_id")
    return newest if limit is None else newest.limit(limit)


def suite_summary(runs: DataFrame) -> DataFrame:
    """Runs per suite; one failed run fails the suite."""
    bad = F.bool_or(F.col("status").isin("failed", "invalid"))
    return runs.groupBy("suite").agg(
        F.count("*").alias("run_count"),
        F.count_if(F.col("status").isin("failed", "invalid")).alias("failed_runs"),
        F.when(bad, F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
        F.max("created_at").alias("last_run"),
    )
