"""Transformation recipes: an ordered, lazy chain of table edits.

Order: drop, rename, cast, fill, drop missing, drop duplicates, clip, date parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import dates
from tabloom.functions.values import (
    is_floating_type,
    is_numeric_type,
    null_if_nan,
    nulls_unified,
    quoted,
    to_boolean,
    to_number,
)
from tabloom.operators.profile import missing_by_column
from tabloom.plans.longform import numeric_long
from tabloom.plans.quantiles import long_quantiles


class RecipeError(ValueError):
    """A rule names a column that is not there, or the result is empty."""


@dataclass(frozen=True)
class Fill:
    column: str
    strategy: str  # mean, median, mode or constant
    value: Any = None


@dataclass(frozen=True)
class Clip:
    column: str
    factor: float = 1.5


@dataclass(frozen=True)
class DateParts:
    column: str
    parts: tuple[str, ...] = ("year", "month")


@dataclass(frozen=True)
class Recipe:
    drop: tuple[str, ...] = ()
    rename: tuple[tuple[str, str], ...] = ()
    cast: tuple[tuple[str, str], ...] = ()
    fill: tuple[Fill, ...] = ()
    drop_missing: tuple[str, ...] = ()
    drop_duplicates: bool = False
    clip: tuple[Clip, ...] = ()
    date_parts: tuple[DateParts, ...] = ()


@dataclass
class Transformed:
    """The lazy result and the warnings known from the schema alone."""

    table: DataFrame
    warnings: list[str] = field(default_factory=list)


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise RecipeError(f"no such column: {column}")


def _replace(df: DataFrame, column: str, expr: Column) -> DataFrame:
    return df.withColumn(column, expr)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> Transformed:
    known = [c for c in columns if c in df.columns]
    warnings = [f"drop skipped, no such column: {c}" for c in columns if c not in df.columns]
    return Transformed(df.drop(*known), warnings)


def rename_columns(df: DataFrame, rules: Sequence[tuple[str, str]]) -> Transformed:
    names, warnings = list(df.columns), []
    for source, target in rules:
        if source not in names:
            warnings.append(f"rename skipped, no such column: {source}")
            continue
        if target in names and target != source:
            raise RecipeError(f"rename target exists: {target}")
        names[names.index(source)] = target
    return Transformed(df.toDF(*names), warnings)


def cast_numeric(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, to_number(quoted(column), df.schema[column].dataType))


def cast_datetime(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, dates.parse_timestamp(quoted(column), df.schema[column].dataType))


def cast_string(df: DataFrame, column: str) -> DataFrame:
    source = null_if_nan(quoted(column), df.schema[column].dataType)
    return _replace(df, column, source.cast("string"))


def cast_boolean(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, to_boolean(quoted(column)))


_CASTS = {
    "numeric": cast_numeric,
    "datetime": cast_datetime,
    "string": cast_string,
    "category": cast_string,
    "boolean": cast_boolean,
}


def cast_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    _require(df, column)
    if kind not in _CASTS:
        raise RecipeError(f"unknown cast: {kind}")
    return _CASTS[kind](df, column)


def _filled(df: DataFrame, column: str, fill: Column, numeric_fill: bool) -> Column:
    data_type = df.schema[column].dataType
    source = null_if_nan(quoted(column), data_type)
    if numeric_fill and is_numeric_type(data_type):
        return F.coalesce(source.cast("double"), fill.cast("double"))
    return F.coalesce(source, fill.cast(data_type.simpleString()))


def fill_missing(df: DataFrame, rules: Sequence[Fill]) -> DataFrame:
    """Fill several columns at once.

    Means share one aggregate and medians one quantile pass; every statistic
    ends as a single row that is broadcast to the rows.
    """
    seen: set[str] = set()
    for i, rule in enumerate(rules):
        _require(df, rule.column)
        if rule.column in seen:  # a second rule sees the result of the first
            return fill_missing(fill_missing(df, rules[:i]), rules[i:])
        seen.add(rule.column)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    means = [r.column for r in rules if r.strategy == "mean"]
    medians = [r.column for r in rules if r.strategy == "median"]
    statistics = []
    if means:
        statistics.append(
            df.agg(*[F.avg(to_number(quoted(c), kinds[c])).alias(f"_mean_{c}") for c in means])
        )
    if medians:
        q = long_quantiles(numeric_long(df, medians, strip_commas=False), [0.5])
        statistics.append(
            q.agg(
                *[
                    F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"_median_{c}")
                    for c in medians
                ]
            )
        )
    exprs: dict[str, Column] = {}
    for rule in rules:
        c = rule.column
        if rule.strategy == "mean":
            exprs[c] = _filled(df, c, quoted(f"_mean_{c}"), True)
        elif rule.strategy == "median":
            exprs[c] = _filled(df, c, quoted(f"_median_{c}"), True)
        elif rule.strategy == "mode":
            source = null_if_nan(quoted(c), kinds[c]).alias("_m")
            counts = df.select(source).where(F.col("_m").isNotNull()).groupBy("_m").count()
            top = counts.orderBy(F.desc("count"), F.asc("_m")).limit(1)
            statistics.append(top.agg(F.first("_m").alias(f"_mode_{c}")))
            fallback = F.coalesce(quoted(f"_mode_{c}"), F.lit(rule.value))
            exprs[c] = _filled(df, c, fallback, is_floating_type(kinds[c]))
        elif rule.strategy == "constant":
            numeric = isinstance(rule.value, float)
            exprs[c] = _filled(df, c, F.lit(rule.value), numeric)
        else:
            raise RecipeError(f"unknown fill strategy: {rule.strategy}")
    joined = df
    for one_row in statistics:
        joined = joined.crossJoin(F.broadcast(one_row))
    return joined.select(*[exprs.get(c, quoted(c)).alias(c) for c in df.columns])


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return fill_missing(df, [Fill(column, "mean")])


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return fill_missing(df, [Fill(column, "median")])


def fill_mode(df: DataFrame, column: str, value: Any = None) -> DataFrame:
    return fill_missing(df, [Fill(column, "mode", value)])


def fill_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    return fill_missing(df, [Fill(column, "constant", value)])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        _require(df, c)
    return df.dropna(how="any", subset=list(columns))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row duplicates; missing values compare equal."""
    return nulls_unified(df).dropDuplicates()


def iqr_clip(df: DataFrame, rules: Sequence[Clip]) -> DataFrame:
    """Clip to the IQR fences; a column without spread stays as it is."""
    for rule in rules:
        _require(df, rule.column)
        if not 0 < rule.factor <= 10:
            raise RecipeError("clip factor must be in (0, 10]")
    names = [r.column for r in rules]
    q = long_quantiles(numeric_long(df, names, strip_commas=False), [0.25, 0.75])
    one = q.agg(
        *[
            F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"_q_{i}")
            for i, c in enumerate(names)
        ]
    )
    exprs = {}
    for i, rule in enumerate(rules):
        v = to_number(quoted(rule.column), df.schema[rule.column].dataType)
        q1, q3 = F.col(f"_q_{i}")[0], F.col(f"_q_{i}")[1]
        low, high = q1 - rule.factor * (q3 - q1), q3 + rule.factor * (q3 - q1)
        clipped = F.when(v < low, low).when(v > high, high).otherwise(v)
        exprs[rule.column] = F.when(q3 > q1, clipped).otherwise(v)
    joined = df.crossJoin(F.broadcast(one))
    return joined.select(*[exprs.get(c, quoted(c)).alias(c) for c in df.columns])


def datetime_parts(df: DataFrame, column: str, parts: Sequence[str]) -> Transformed:
    _require(df, column)
    stamp = dates.parse_timestamp(quoted(column), df.schema[column].dataType)
    new, warnings = {}, []
    for part in parts:
        if part in dates.PARTS:
            new[f"{column}_{part}"] = dates.date_part(stamp, part)
        else:
            warnings.append(f"date part skipped, unsupported: {part}")
    return Transformed(df.withColumns(new) if new else df, warnings)


def apply_recipe(df: DataFrame, recipe: Recipe) -> Transformed:
    """Compose the rules in their fixed order; nothing runs until an action."""
    dropped = drop_columns(df, recipe.drop)
    renamed = rename_columns(dropped.table, recipe.rename)
    warnings = dropped.warnings + renamed.warnings
    table = renamed.table
    for column, kind in recipe.cast:
        table = cast_column(table, column, kind)
    if recipe.fill:
        table = fill_missing(table, recipe.fill)
    if recipe.drop_missing:
        table = drop_missing(table, recipe.drop_missing)
    if recipe.drop_duplicates:
        table = drop_duplicates(table)
    if recipe.clip:
        table = iqr_clip(table, recipe.clip)
    for rule in recipe.date_parts:
        result = datetime_parts(table, rule.column, rule.parts)
        table, warnings = result.table, warnings + result.warnings
    if not table.columns:
        raise RecipeError("the recipe leaves no column")
    return Transformed(table, warnings)


def preview_recipe(
    df: DataFrame, recipe: Recipe, order_by: Sequence[str], n: int = 20
) -> Transformed:
    """The first rows of the result; writes nothing."""
    result = apply_recipe(df, recipe)
    keys = [c for c in order_by if c in result.table.columns]
    return Transformed(result.table.orderBy(*keys).limit(n), result.warnings)


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of row, column and missing-cell deltas with added and removed columns."""

    def totals(df: DataFrame, tag: str) -> DataFrame:
        return missing_by_column(df).agg(
            F.max("row_count").alias(f"{tag}_rows"),
            F.count("*").alias(f"{tag}_columns"),
            F.sum("missing_count").alias(f"{tag}_missing"),
        )

    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    both = totals(before, "before").crossJoin(F.broadcast(totals(after, "after")))
    return both.select(
        "before_rows",
        "after_rows",
        (F.col("after_rows") - F.col("before_rows")).alias("row_delta"),
        (F.col("after_columns") - F.col("before_columns")).alias("column_delta"),
        (F.col("after_missing") - F.col("before_missing")).alias("missing_delta"),
        F.lit(",".join(added)).alias("added_columns"),
        F.lit(",".join(removed)).alias("removed_columns"),
    )
