"""Versioned datasets: immutable Parquet snapshots and one metadata row each.

Layout under a root folder::

    data/dataset_id=<id>/version_index=<n>/   one snapshot, own schema
    versions/                                 appended metadata rows

A snapshot is written first and its metadata row last, so a failed job leaves
no visible version.  One writer per dataset at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.recipe import Recipe, apply_recipe, profile_diff
from tabloom.sources.tables import TableError, fingerprint, validate

VERSION_SCHEMA = (
    "dataset_id string, version_id string, version_index int, kind string, "
    "source_version_id string, row_count bigint, column_count int, columns string, "
    "recipe string, diff string, warnings string, content_hash string, created_at timestamp"
)


def _data_path(root: str, dataset_id: str, index: int) -> str:
    return f"{root}/data/dataset_id={dataset_id}/version_index={index}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/versions"
    if not _exists(spark, path):
        return spark.createDataFrame([], VERSION_SCHEMA)
    return spark.read.schema(VERSION_SCHEMA).parquet(path)


def list_versions(meta: DataFrame, dataset_id: str) -> DataFrame:
    """Versions in ascending order, each with the id of the latest one."""
    own = meta.where(F.col("dataset_id") == dataset_id)
    latest = own.agg(F.max_by("version_id", "version_index").alias("latest_version_id"))
    return own.crossJoin(F.broadcast(latest)).orderBy("version_index")


def list_datasets(meta: DataFrame) -> DataFrame:
    """One row per dataset, newest first."""
    return (
        meta.groupBy("dataset_id")
        .agg(
            F.max_by("version_id", "version_index").alias("latest_version_id"),
            F.count("*").alias("version_count"),
            F.max_by("row_count", "version_index").alias("row_count"),
            F.max_by("column_count", "version_index").alias("column_count"),
            F.min("created_at").alias("created_at"),
        )
        .orderBy(F.desc("created_at"), "dataset_id")
    )


def _version_row(spark: SparkSession, root: str, dataset_id: str, version_id: str | None):
    own = versions(spark, root).where(F.col("dataset_id") == dataset_id)
    if version_id is not None:
        own = own.where(F.col("version_id") == version_id)
    row = own.orderBy(F.desc("version_index")).first()
    if row is None:
        raise TableError(f"unknown dataset or version: {dataset_id} {version_id or ''}".strip())
    return row


def load_version(
    spark: SparkSession, root: str, dataset_id: str, version_id: str | None = None
) -> DataFrame:
    """A version by id; the highest index when none is given."""
    row = _version_row(spark, root, dataset_id, version_id)
    return spark.read.parquet(_data_path(root, dataset_id, row["version_index"]))


def _append(spark: SparkSession, root: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def save_version(
    df: DataFrame,
    root: str,
    dataset_id: str,
    source_version_id: str | None = None,
    recipe: Recipe | None = None,
    warnings: Sequence[str] = (),
    diff: Mapping | None = None,
) -> str:
    """Write the next version and return its id."""
    spark = df.sparkSession
    newest = (
        versions(spark, root)
        .where(F.col("dataset_id") == dataset_id)
        .agg(F.max("version_index").alias("i"))
        .first()["i"]
    )
    index = (newest or 0) + 1
    path = _data_path(root, dataset_id, index)
    df.write.mode("overwrite").parquet(path)
    stored = validate(spark.read.parquet(path))
    hashed = fingerprint(stored).first()
    version_id = f"v{index}-{uuid.uuid4().hex[:8]}"
    row = (
        dataset_id,
        version_id,
        index,
        "original" if index == 1 else "derived",
        source_version_id,
        hashed["row_count"],
        len(stored.columns),
        json.dumps(stored.columns),
        json.dumps(asdict(recipe)) if recipe else None,
        json.dumps(diff) if diff else None,
        json.dumps(list(warnings)),
        f"{hashed['hash_xor']:x}:{hashed['hash_sum']}",
        datetime.now(UTC),
    )
    _append(spark, root, spark.createDataFrame([row], VERSION_SCHEMA))
    return version_id


def apply_and_save(
    spark: SparkSession, root: str, dataset_id: str, recipe: Recipe, version_id: str | None = None
) -> str:
    """Run a recipe on a stored version and keep the result as the next one."""
    source = _version_row(spark, root, dataset_id, version_id)
    before = load_version(spark, root, dataset_id, source["version_id"])
    result = apply_recipe(before, recipe)
    diff = profile_diff(before, result.table).first().asDict()
    return save_version(
        result.table, root, dataset_id, source["version_id"], recipe, result.warnings, diff
    )


def export_dataset(
    spark: SparkSession, root: str, dataset_id: str, target: str, models: DataFrame | None = None
) -> None:
    """Copy every version of a dataset and its registry rows to a new root."""
    own = versions(spark, root).where(F.col("dataset_id") == dataset_id)
    for row in own.select("version_index").collect():  # one row per version
        index = row["version_index"]
        spark.read.parquet(_data_path(root, dataset_id, index)).write.parquet(
            _data_path(target, dataset_id, index)
        )
    _append(spark, target, own)
    if models is not None:
        models.where(F.col("dataset_id") == dataset_id).write.parquet(f"{target}/models")


def import_dataset(
    spark: SparkSession, bundle: str, root: str, new_dataset_id: str
) -> tuple[DataFrame, DataFrame | None]:
    """Copy a bundle in under new ids; imported models become candidates.

    Returns the old-to-new id mapping and the rewritten model rows, if any.
    """
    meta = versions(spark, bundle)
    old = meta.select("dataset_id").distinct().collect()
    if len(old) != 1:
        raise TableError("a bundle holds exactly one dataset")
    old_id = old[0]["dataset_id"]
    tag = uuid.uuid4().hex[:8]
    mapping = meta.select(
        F.lit("version").alias("kind"),
        F.col("version_id").alias("old_id"),
        F.concat(F.lit("v"), F.col("version_index"), F.lit("-" + tag)).alias("new_id"),
    ).unionByName(
        spark.range(1).select(
            F.lit("dataset").alias("kind"),
            F.lit(old_id).alias("old_id"),
            F.lit(new_dataset_id).alias("new_id"),
        )
    )
    for row in meta.select("version_index").collect():  # one row per version
        index = row["version_index"]
        spark.read.parquet(_data_path(bundle, old_id, index)).write.parquet(
            _data_path(root, new_dataset_id, index)
        )
    renamed = rewrite_ids(meta, mapping, ["dataset_id", "version_id", "source_version_id"])
    columns = [f.name for f in T._parse_datatype_string(VERSION_SCHEMA).fields]
    _append(spark, root, renamed.select(*columns))
    models = None
    if _exists(spark, f"{bundle}/models"):
        stored = spark.read.parquet(f"{bundle}/models")
        fresh = stored.select("model_id").distinct().select(
            F.lit("model").alias("kind"),
            F.col("model_id").alias("old_id"),
            F.concat("model_id", F.lit("-" + tag)).alias("new_id"),
        )
        mapping = mapping.unionByName(fresh)
        models = rewrite_ids(stored, mapping, ["dataset_id", "version_id", "model_id"])
        models = models.withColumn("status", F.lit("candidate"))
    return mapping, models


def rewrite_ids(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace old ids by new ones in every listed column that exists."""
    pairs = mapping.select("old_id", "new_id")
    result = df
    for c in [c for c in columns if c in df.columns]:
        named = pairs.toDF("_old", "_new")
        replaced: Column = F.coalesce("_new", c)
        result = result.join(named, F.col(c) == F.col("_old"), "left").withColumn(c, replaced)
        result = result.drop("_old", "_new")
    return result
