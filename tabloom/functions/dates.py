"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.values import is_temporal_type

# Date layouts tried after ISO, and the shapes that look like one.
DATE_FORMATS = ["yyyy/M/d", "M/d/yyyy", "d/M/yyyy"]
DATE_SHAPES = [r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"]

PARTS = ["year", "month", "day", "dayofweek"]


def parse_timestamp(column: Column, data_type: T.DataType | None = None) -> Column:
    """ISO first, then the fixed layouts; NULL when nothing parses.

    The layouts all hold a slash.  Texts without one are not tried: each failing try raises and catches an exception.
    """
    if data_type is not None and is_temporal_type(data_type):
        return column.cast("timestamp_ntz")
    text = F.trim(column.cast("string"))
    attempts = [F.try_to_timestamp(text)]
    slash = F.contains(text, F.lit("/"))
    attempts += [F.when(slash, F.try_to_timestamp(text, F.lit(layout))) for layout in DATE_FORMATS]
    return F.coalesce(*attempts).cast("timestamp_ntz")


def looks_like_date(column: Column) -> Column:
    return column.rlike(DATE_SHAPES[0]) | column.rlike(DATE_SHAPES[1])


def date_part(column: Column, part: str) -> Column:
    if part == "year":
        return F.year(column)
    if part == "month":
        return F.month(column)
    if part == "day":
        return F.dayofmonth(column)
    if part == "dayofweek":
        return F.weekday(column)
    if part == "quarter":
        return F.quarter(column)
    if part == "is_month_end":
        return (F.to_date(column) == F.last_day(column)).cast("int")
    raise ValueError(f"unsupported date part: {part}")
