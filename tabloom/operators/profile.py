"""Column profiling: missing and unique counts, inferred types, roles, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import dates
from tabloom.functions.stats import sample_kurtosis, sample_skewness
from tabloom.functions.values import (
    BOOLEAN_TOKENS,
    is_numeric_type,
    is_temporal_type,
    null_if_nan,
    quoted,
    rounded,
    safe_ratio,
    text_to_number,
    to_number,
)
from tabloom.plans.longform import (
    column_order,
    numeric_columns,
    numeric_long,
    rows_from_one,
    to_long,
    value_counts_long,
)
from tabloom.plans.quantiles import long_quantiles

# Names and endings that give a column its role.
TARGET_NAMES = [
    "target", "label", "class", "outcome", "result", "churn", "survived",
    "default", "is_fraud",
]
TARGET_SUFFIXES = ["_target", "_label", "_class", "_outcome"]
IDENTIFIER_NAMES = [
    "id", "uuid", "guid", "record_id", "row_id", "customer_id", "user_id",
    "transaction_id", "order_id",
]
IDENTIFIER_SUFFIXES = ["_id", "_uuid", "_guid"]

# Thresholds of the type decision.
NUMERIC_SHARE = 0.9
DATE_SHARE = 0.8
CATEGORY_UNIQUES = 30
CATEGORY_RATIO = 0.35
TEXT_LENGTH = 40.0
LONGEST_DATE_TEXT = 40


def physical_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric_type(data_type):
        return "numeric"
    return "datetime" if is_temporal_type(data_type) else "text"


def schema_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, position, physical) from the schema alone."""
    names = list(columns or df.columns)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.lit(physical_kind(df.schema[c].dataType)).alias("physical"),
        )
        for i, c in enumerate(names)
    ]
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One pass, one wide aggregate; nothing but a single row is shuffled."""
    names = list(columns or df.columns)
    present = df.agg(
        F.count("*").alias("_n"),
        *[
            F.count(null_if_nan(quoted(c), df.schema[c].dataType)).alias(f"_p{i}")
            for i, c in enumerate(names)
        ],
    )
    rows = [
        {
            "column": F.lit(c),
            "row_count": F.col("_n"),
            "missing_count": F.col("_n") - F.col(f"_p{i}"),
            "missing_ratio": safe_ratio(F.col("_n") - F.col(f"_p{i}"), F.col("_n")),
        }
        for i, c in enumerate(names)
    ]
    return rows_from_one(present, rows)


def unique_by_column(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Distinct non-missing values per column; ``approximate`` trades exactness
    for a sketch that shuffles one row per task."""
    names = list(columns or df.columns)
    if approximate:
        sketch = df.agg(
            F.count("*").alias("_n"),
            *[
                F.approx_count_distinct(
                    null_if_nan(quoted(c), df.schema[c].dataType), 0.02
                ).alias(f"_u{i}")
                for i, c in enumerate(names)
            ],
        )
        return rows_from_one(
            sketch,
            [
                {
                    "column": F.lit(c),
                    "unique_count": F.col(f"_u{i}"),
                    "unique_ratio": safe_ratio(F.col(f"_u{i}"), F.col("_n")),
                }
                for i, c in enumerate(names)
            ],
        )
    counts = value_counts_long(df, names)
    return counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        safe_ratio(F.count("value"), F.sum("cnt")).alias("unique_ratio"),
    )


def boolean_flag(token: Column) -> Column:
    """Aggregate over distinct values: all are tokens, at most two of them."""
    position = F.array_position(F.array(*map(F.lit, BOOLEAN_TOKENS)), token)
    bits = F.bit_or(F.when(token.isNotNull(), F.pow(F.lit(2), position).cast("long")))
    # Position 0 (not a token) sets the lowest bit.
    return F.coalesce((bits.bitwiseAND(F.lit(1)) == 0) & (F.bit_count(bits) <= 2), F.lit(False))


def column_facts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Everything the type decision needs, per column.

    Exact: one pass over value counts, so every distinct value is shuffled once.
    ``approximate``: sketched distinct counts in a wide aggregate that shuffles
    one row per task, for tables with huge identifier columns.
    """
    names = list(columns or df.columns)
    facts = _sketched_facts(df, names) if approximate else _counted_facts(df, names)
    return schema_table(df, names).join(F.broadcast(facts), "column", "left")


def _value_tests(value: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a number, looks like a date, parses as a date."""
    short = (F.length(value) <= LONGEST_DATE_TEXT) & value.rlike("[0-9]")
    return (
        text_to_number(value, strip_commas=True).isNotNull(),
        F.when(short, dates.looks_like_date(value)).otherwise(False),
        short & dates.parse_timestamp(value).isNotNull(),
    )


def _counted_facts(df: DataFrame, names: list[str]) -> DataFrame:
    counts = value_counts_long(df, names)
    value, cnt = F.col("value"), F.col("cnt")
    number, like, parses = _value_tests(value)
    weight = F.when(value.isNotNull(), cnt)
    return counts.groupBy("column").agg(
        F.sum("cnt").alias("row_count"),
        F.sum(F.when(value.isNull(), cnt).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
        boolean_flag(F.lower(F.trim(value))).alias("boolean_tokens"),
        (F.sum(F.when(number, cnt).otherwise(0)) / F.sum(weight)).alias("numeric_share"),
        (F.sum(F.length(value) * cnt) / F.sum(weight)).alias("mean_length"),
        F.max(like).alias("date_like"),
        (F.sum(F.when(parses, cnt).otherwise(0)) / F.sum(weight)).alias("date_share"),
    )


def _sketched_facts(df: DataFrame, names: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("_n")]
    rows = []
    for i, c in enumerate(names):
        value = null_if_nan(quoted(c), df.schema[c].dataType).cast("string")
        number, like, parses = _value_tests(value)
        present = F.count(value)
        named = {
            "present": present,
            "unique_count": F.approx_count_distinct(value, 0.02),
            "boolean_tokens": boolean_flag(F.lower(F.trim(value))),
            "numeric_share": F.count_if(number) / F.nullif(present, F.lit(0)),
            "mean_length": F.avg(F.length(value)),
            "date_like": F.max(like),
            "date_share": F.count_if(parses) / F.nullif(present, F.lit(0)),
        }
        aggs += [expr.alias(f"_{key}{i}") for key, expr in named.items()]
        rows.append(
            {
                "column": F.lit(c),
                "row_count": F.col("_n"),
                "missing_count": F.col("_n") - F.col(f"_present{i}"),
                **{key: F.col(f"_{key}{i}") for key in named if key != "present"},
            }
        )
    return rows_from_one(df.agg(*aggs), rows)


def _first_values(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int
) -> DataFrame:
    """First ``k`` non-missing values per column in row order.

    The rank filter lets Spark drop all but k rows per column and task before
    the shuffle.
    """
    keyed = df.select(
        F.struct(*[F.col(c) for c in order_by]).alias("_key"), *[quoted(c) for c in columns]
    )
    long = to_long(keyed, columns, keep=["_key"]).where(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy("column").orderBy("_key"))
    return long.withColumn("rank", rank).where(F.col("rank") <= k).drop("_key")


def detect_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date detection on all non-missing values of each column."""
    counts = value_counts_long(df, columns).where(F.col("value").isNotNull())
    _, like, parses = _value_tests(F.col("value"))
    share = F.sum(F.when(parses, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    return counts.groupBy("column").agg(
        rounded(share).alias("parse_ratio"), (F.max(like) & (share >= DATE_SHARE)).alias("is_datetime")
    )


def detect_boolean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counts = value_counts_long(df, columns)
    return counts.groupBy("column").agg(
        boolean_flag(F.lower(F.trim("value"))).alias("is_boolean")
    )


def detect_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counts = value_counts_long(df, columns).where(F.col("value").isNotNull())
    parsed = F.when(text_to_number(F.col("value"), True).isNotNull(), F.col("cnt")).otherwise(0)
    share = F.sum(parsed) / F.sum("cnt")
    return counts.groupBy("column").agg(
        rounded(share).alias("parse_ratio"), (share >= NUMERIC_SHARE).alias("is_numeric")
    )


def inferred_type() -> Column:
    """The decision chain over the columns of ``column_facts``."""
    present = F.coalesce(F.col("row_count") - F.col("missing_count"), F.lit(0))
    ratio = safe_ratio(F.col("unique_count"), present)
    return (
        F.when(present == 0, F.lit("unknown"))
        .when((F.col("physical") == "boolean") | F.col("boolean_tokens"), F.lit("boolean"))
        .when(F.col("physical") == "numeric", F.lit("numeric"))
        .when(F.col("physical") == "datetime", F.lit("datetime"))
        .when(F.col("numeric_share") >= NUMERIC_SHARE, F.lit("numeric"))
        .when(F.col("date_like") & (F.col("date_share") >= DATE_SHARE), F.lit("datetime"))
        .when(
            (F.col("unique_count") <= CATEGORY_UNIQUES) | (ratio <= CATEGORY_RATIO),
            F.lit("categorical"),
        )
        .when(F.col("mean_length") >= TEXT_LENGTH, F.lit("text"))
        .otherwise(F.lit("categorical"))
    )


def semantic_role(name: Column, column_type: Column) -> Column:
    plain = F.lower(F.trim(name))

    def named(names: list[str], suffixes: list[str]) -> Column:
        test = plain.isin(names)
        for suffix in suffixes:
            test = test | plain.endswith(suffix)
        return test

    return (
        F.when(named(TARGET_NAMES, TARGET_SUFFIXES), F.lit("target_candidate"))
        .when(named(IDENTIFIER_NAMES, IDENTIFIER_SUFFIXES), F.lit("identifier"))
        .when(column_type == "datetime", F.lit("datetime"))
        .otherwise(F.lit("feature_candidate"))
    )


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    facts = column_facts(df, columns, order_by)
    return facts.select("column", "position", inferred_type().alias("inferred_type"))


def infer_roles(types: DataFrame) -> DataFrame:
    return types.withColumn("semantic_role", semantic_role(F.col("column"), F.col("inferred_type")))


def base_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Counts, type and role per column: the table most rules read."""
    facts = column_facts(df, columns, order_by, approximate)
    zero = F.lit(0).cast("long")
    typed = facts.select(
        "column",
        "position",
        "physical",
        inferred_type().alias("inferred_type"),
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("missing_count", zero).alias("missing_count"),
        F.coalesce("unique_count", zero).alias("unique_count"),
        F.coalesce("mean_length", F.lit(0.0)).alias("mean_length"),
    )
    return typed.select(
        "*",
        semantic_role(F.col("column"), F.col("inferred_type")).alias("semantic_role"),
        safe_ratio(F.col("missing_count"), F.col("row_count")).alias("missing_ratio"),
        safe_ratio(F.col("unique_count"), F.col("row_count")).alias("unique_ratio"),
    )


def sample_values(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, k: int = 5
) -> DataFrame:
    """(column, rank, value): first k non-missing values in row order."""
    return _first_values(df, list(columns or df.columns), order_by, k).select(
        "column", "rank", "value"
    )


def top_values(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rank, value, count); missing counts as a value, ties by value."""
    counts = value_counts_long(df, columns)
    order = Window.partitionBy("column").orderBy(
        F.desc("cnt"), F.col("value").asc_nulls_last()
    )
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("column", "rank", "value", F.col("cnt").alias("count"))
    )


def moments(
    df: DataFrame, columns: Sequence[str] | None = None, shape: bool = False, chunk: int = 40
) -> DataFrame:
    """Unrounded count, mean, std, min, max (and skewness, kurtosis) per column.

    A wide aggregate keeps everything in one generated loop; very wide tables
    are cut into several aggregates so the generated code stays compilable.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    result = None
    for start in range(0, max(len(names), 1), chunk):
        part = names[start : start + chunk]
        numbers = df.select(
            *[
                to_number(quoted(c), df.schema[c].dataType, strip_commas=True).alias(f"_v{i}")
                for i, c in enumerate(part)
            ]
        )
        aggs, rows = [F.count("*").alias("_rows")], []
        for i, c in enumerate(part):
            v = F.col(f"_v{i}")
            named = {
                "count": F.count(v),
                "mean": F.avg(v),
                "std": F.stddev_samp(v),
                "min": F.min(v),
                "max": F.max(v),
            }
            if shape:
                named["skewness"] = sample_skewness(v)
                named["kurtosis"] = sample_kurtosis(v)
            aggs += [expr.alias(f"_{key}{i}") for key, expr in named.items()]
            rows.append({"column": F.lit(c), **{key: F.col(f"_{key}{i}") for key in named}})
        if not rows:
            raise ValueError("no numeric columns")
        piece = rows_from_one(numbers.agg(*aggs), rows)
        result = piece if result is None else result.unionByName(piece)
    return result


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, std, min, quartiles, max per numeric column, four decimals."""
    names = list(columns) if columns is not None else numeric_columns(df)
    quartiles = long_quantiles(numeric_long(df, names), [0.25, 0.5, 0.75])
    joined = moments(df, names).join(F.broadcast(quartiles), "column").where("count > 0")
    return joined.select(
        "column",
        rounded(F.col("mean")).alias("mean"),
        rounded(F.col("std")).alias("std"),
        rounded(F.col("min")).alias("min"),
        rounded(F.col("q")[0]).alias("q25"),
        rounded(F.col("q")[1]).alias("median"),
        rounded(F.col("q")[2]).alias("q75"),
        rounded(F.col("max")).alias("max"),
    )


def datetime_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.select(
        *[
            dates.parse_timestamp(quoted(c), df.schema[c].dataType).alias(f"_t{i}")
            for i, c in enumerate(columns)
        ]
    ).agg(
        *[
            agg(f"_t{i}").alias(f"_{name}{i}")
            for i in range(len(columns))
            for name, agg in (("min", F.min), ("max", F.max))
        ]
    )
    rows = [
        {"column": F.lit(c), "min": F.col(f"_min{i}"), "max": F.col(f"_max{i}")}
        for i, c in enumerate(columns)
    ]
    return rows_from_one(one, rows).where(F.col("min").isNotNull())


def profile_columns(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
    samples: int = 5,
) -> DataFrame:
    """Full profile: counts, type, role, samples, top values and statistics.

    The joined pieces have one row per column, so they are broadcast.
    """
    names = list(columns or df.columns)
    base = base_profile(df, names, order_by)
    first = sample_values(df, order_by, names, samples).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        .alias("sample_values")
    )
    top = top_values(df, samples, names).groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")),
        ).alias("top_values")
    )
    plain = [c for c in names if not is_temporal_type(df.schema[c].dataType)]
    temporal = [c for c in names if not is_numeric_type(df.schema[c].dataType)]
    profile = base.join(F.broadcast(first), "column", "left").join(
        F.broadcast(top), "column", "left"
    )
    if plain:
        stats = numeric_stats(df, plain)
        packed = stats.select(
            "column", F.struct(*[c for c in stats.columns if c != "column"]).alias("_num")
        )
        profile = profile.join(F.broadcast(packed), "column", "left").withColumn(
            "numeric_stats", F.when(F.col("inferred_type") == "numeric", F.col("_num"))
        ).drop("_num")
    if temporal:
        spans = datetime_stats(df, temporal).select(
            "column", F.struct("min", "max").alias("_span")
        )
        profile = profile.join(F.broadcast(spans), "column", "left").withColumn(
            "datetime_stats", F.when(F.col("inferred_type") == "datetime", F.col("_span"))
        ).drop("_span")
    return profile


def schema_summary(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """One row: sizes, type counts, missing cells, duplicate rows, target candidates."""
    from tabloom.operators.eda import duplicate_analysis

    names = list(columns or df.columns)
    profile = base_profile(df, names, order_by)
    kinds = ["numeric", "categorical", "datetime", "boolean", "text", "unknown"]
    one = profile.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        *[F.count_if(F.col("inferred_type") == k).alias(f"{k}_columns") for k in kinds],
        F.sum("missing_count").alias("missing_cell_count"),
        safe_ratio(F.sum("missing_count"), F.max("row_count") * F.count("*")).alias(
            "missing_cell_ratio"
        ),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.when(
                            F.col("semantic_role") == "target_candidate",
                            F.struct("position", "column"),
                        )
                    )
                ),
                lambda s: s["column"],
            ),
            ",",
        ).alias("target_candidates"),
    )
    duplicates = duplicate_analysis(df.select(*[quoted(c) for c in names]))
    return one.crossJoin(
        F.broadcast(duplicates.select("duplicate_row_count", "duplicate_row_ratio"))
    )


__all__ = [
    "base_profile", "column_facts", "column_order", "datetime_stats", "detect_boolean",
    "detect_datetime", "detect_numeric", "infer_roles", "infer_types", "missing_by_column",
    "moments", "numeric_stats", "profile_columns", "sample_values", "schema_summary",
    "schema_table", "top_values", "unique_by_column",
]
