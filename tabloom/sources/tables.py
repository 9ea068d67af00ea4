"""Reading, checking and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.values import null_tokens_to_null, quoted, text_to_number
from tabloom.sources.csvrecords import ENCODINGS, column_names, file_facts, records

PREVIEW_ROWS = 20


class TableError(ValueError):
    """The table cannot be read or holds nothing."""


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encodings: Sequence[str] = ENCODINGS,
    promote: bool = True,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with header; cells with a missing-value token become NULL.

    Each file is read in the first encoding that decodes all its bytes and by its own header, so
    files whose columns stand in another order, or that lack some, fit together.  Cells may hold line
    breaks and doubled quotes; files are split over tasks all the same.
    """
    groups: dict[tuple, list] = {}
    for file in file_facts(spark, path, encodings):
        if file.encoding is None:
            raise TableError(f"no encoding decodes {file.path}")
        groups.setdefault((file.encoding, file.header), []).append(file)
    whole = None
    for (encoding, header), files in sorted(groups.items(), key=lambda g: g[0]):
        names = column_names(header, encoding)
        if not names:
            raise TableError("the file has no columns")
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = F.from_csv("record", schema, {"mode": mode, "escape": '"'})
        cells = records(spark, files, encoding).select(parsed.alias("r"))
        plain = cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
        whole = plain if whole is None else whole.unionByName(plain, allowMissingColumns=True)
    if whole is None:
        raise TableError("the file has no columns")
    texts = whole.select(*[null_tokens_to_null(quoted(c)).alias(c) for c in whole.columns])
    return promote_types(texts) if promote else texts


def promote_types(df: DataFrame) -> DataFrame:
    """Text columns in which every cell is a number (or true/false) change type.

    One scan gives one row of counts per column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        cell = quoted(c)
        aggs += [
            F.count(cell).alias(f"n{i}"),
            F.count(text_to_number(cell, False)).alias(f"d{i}"),
            F.count_if(cell.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{i}"),
            F.count_if(cell.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    counts = df.agg(*aggs).first()
    casts: dict[str, Column] = {}
    for i, c in enumerate(names):
        n = counts[f"n{i}"]
        if n == 0:
            continue
        if counts[f"i{i}"] == n:
            casts[c] = F.trim(quoted(c)).try_cast("bigint")
        elif counts[f"d{i}"] == n:
            casts[c] = text_to_number(quoted(c), False)
        elif counts[f"b{i}"] == n:
            casts[c] = F.lower(quoted(c)).try_cast("boolean")
    return df.select(*[casts.get(c, quoted(c)).alias(c) for c in df.columns])


def validate(df: DataFrame) -> DataFrame:
    """At least one column and one row, else an error."""
    if not df.columns:
        raise TableError("the table has no columns")
    if df.isEmpty():
        raise TableError("the table has no rows")
    return df


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by the order key as JSON records, NULLs kept."""
    rows = df.orderBy(*order_by).limit(n)
    record = F.to_json(
        F.struct(*[quoted(c) for c in df.columns]),
        {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"},
    )
    return rows.select(*[quoted(c) for c in order_by], record.alias("record"))


def align(df: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """Exactly the wanted columns: missing ones NULL, extra ones dropped."""
    return df.select(
        *[
            quoted(c) if c in df.columns else F.lit(None).cast("string").alias(c)
            for c in feature_columns
        ]
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count, xor and sum of row hashes."""
    row = F.xxhash64(*[quoted(c) for c in df.columns])
    return df.agg(
        F.count("*").alias("row_count"),
        F.bit_xor(row).alias("hash_xor"),
        F.sum(row.cast("decimal(38,0)")).alias("hash_sum"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, JSON or CSV sink."""
    if fmt not in ("parquet", "json", "csv"):
        raise TableError(f"unknown format: {fmt}")
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)
