"""Readers for the star-schema tables and the derived inputs queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """documents with labels where present: the input with missing cells."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id")


DOCUMENT_LABELS_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
LABELLED_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def long_sql(source: str, columns: list[str]) -> str:
    """One row per column and cell, as text."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {source}" for c in columns
    )


def numeric_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def dirty_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as a CSV would hold them: thousands separators, gaps, date texts."""
    base = document_labels(spark, folder)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(28)).cast("int"))
    return base.select(
        "doc_id",
        F.format_number("n_chars", 0).alias("size_text"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
        F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("good"),
        "lang",
        F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


DIRTY_SQL = (
    "(SELECT doc_id, format('{:,}', n_chars) AS size_text, "
    "strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%d') AS day_text, "
    "CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS good, lang, "
    "CASE WHEN lang = 'en' THEN NULL ELSE source END AS source "
    f"FROM {DOCUMENT_LABELS_SQL})"
)
