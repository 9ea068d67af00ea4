"""Column expressions for missing values, coercion and labels.

ANSI mode makes a plain ``cast`` fail on dirty data, so user data only ever
goes through ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" in a CSV cell.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Boolean tokens for detection, casting and drift.
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
TRUE_TOKENS = ["true", "1", "yes", "y"]
FALSE_TOKENS = ["false", "0", "no", "n"]
DRIFT_BOOLEAN_TOKENS = ["true", "false", "0", "1"]

# Every text that a cast to double accepts (digits, exponents, hexadecimal forms, "inf", "nan"), and some more.
NUMBER_SHAPE = r"^[+-]?([.0-9][\x00-\x20.0-9+\-xXpPa-fA-F]*$|[iInN])"

MISSING_LABEL = "Missing"
OTHER_LABEL = "Other"
DRIFT_MISSING_LABEL = "<missing>"


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_floating_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def is_temporal_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def quoted(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_nan(column: Column, data_type: T.DataType | None = None) -> Column:
    """NaN and NULL are one notion of missing."""
    if data_type is not None and not is_floating_type(data_type):
        return column
    return F.when(~F.isnan(column), column)


def null_tokens_to_null(column: Column) -> Column:
    return F.when(~column.isin(NULL_TOKENS), column)


def nulls_unified(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floating = {f.name for f in df.schema.fields if is_floating_type(f.dataType)}
    if not floating:
        return df
    return df.select(
        *[
            null_if_nan(quoted(c)).alias(c) if c in floating else quoted(c)
            for c in df.columns
        ]
    )


def text_to_number(column: Column, strip_commas: bool) -> Column:
    """Coerce text to double, NULL where it does not parse.

    A trailing d or f is a Java literal suffix that Spark's cast accepts, so it
    is ruled out here ("inf" excepted).  Texts that hold what no number holds are
    not cast at all: a failing cast raises and catches an exception per row.
    """
    text = F.trim(column)
    if strip_commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    like = text.rlike(NUMBER_SHAPE) & ~text.rlike("[0-9.][dDfF]$")
    return null_if_nan(F.when(like, text.try_cast("double")))


def to_number(
    column: Column, data_type: T.DataType | None = None, strip_commas: bool = False
) -> Column:
    if data_type is not None:
        if is_floating_type(data_type):
            return null_if_nan(column.cast("double"))
        if is_numeric_type(data_type) or isinstance(data_type, T.BooleanType):
            return column.cast("double")
        if is_temporal_type(data_type):
            return F.lit(None).cast("double")
    return text_to_number(column.cast("string"), strip_commas)


def to_boolean(column: Column) -> Column:
    token = F.lower(F.trim(column.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(
        token.isin(FALSE_TOKENS), F.lit(False)
    )


def as_label(column: Column, missing: str = MISSING_LABEL) -> Column:
    return F.coalesce(column.cast("string"), F.lit(missing))


def finite(column: Column) -> Column:
    """Blank infinite results."""
    return F.when((column < float("inf")) & (column > float("-inf")), column)


def safe_ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    ratio = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.round(F.coalesce(ratio, F.lit(0.0)), digits)


def rounded(column: Column, digits: int = 4) -> Column:
    return F.round(finite(null_if_nan(column)), digits)
