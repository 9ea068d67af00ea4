"""Long-form kernels: one row per (column, value) instead of one pass per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import is_numeric_type, nulls_unified, quoted, to_number
from tabloom.plans.sizing import spread


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def to_long(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """(keep…, column, value as text); NULL and NaN stay as NULL rows."""
    names = [c for c in (columns or df.columns) if c not in keep]
    unified = nulls_unified(spread(df.select(*[quoted(c) for c in [*keep, *names]])))
    texts = unified.select(
        *[quoted(c) for c in keep], *[quoted(c).cast("string").alias(c) for c in names]
    )
    return texts.unpivot([quoted(c) for c in keep], [quoted(c) for c in names], name, value)


def numeric_long(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    strip_commas: bool = True,
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """(keep…, column, value as double) without missing values."""
    names = list(columns) if columns is not None else numeric_columns(df)
    names = [c for c in names if c not in keep]
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = spread(df.select(*[quoted(c) for c in [*keep, *names]])).select(
        *[quoted(c) for c in keep],
        *[to_number(quoted(c), types[c], strip_commas).alias(c) for c in names],
    )
    long = numbers.unpivot(
        [quoted(c) for c in keep], [quoted(c) for c in names], name, value
    )
    return long.where(F.col(value).isNotNull())


def value_counts_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, cnt); partial counts are combined before the shuffle."""
    return to_long(df, columns).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def rows_from_one(one_row: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per entry of ``rows``."""
    entries = F.array(
        *[F.struct(*[expr.alias(field) for field, expr in row.items()]) for row in rows]
    )
    return one_row.select(F.explode(entries).alias("r")).select("r.*")


def column_order(columns: Sequence[str], name: str = "column") -> Column:
    """Position of the column name in the table, as an expression."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(name)).cast("int")
