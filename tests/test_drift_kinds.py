"""Kinds of a drift report: which cells are read, and texts that look like numbers or dates."""

import re

from pyspark.sql import functions as F

from tabloom.functions.dates import DATE_FORMATS, parse_timestamp
from tabloom.functions.values import text_to_number
from tabloom.operators import drift


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_text_is_read(spark, tmp_path):
    made = spark.range(200).select(
        "id", (F.col("id") / 4).alias("price"), F.col("id").cast("string").alias("key"), F.lit("1-URGENT").alias("priority"),
        F.lit(None).cast("string").alias("nothing"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
    )
    made.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    kinds = drift._column_kinds(rows, True)
    read = re.search("ReadSchema: struct<(.*?)>", kinds._jdf.queryExecution().simpleString())[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"key", "priority", "nothing"}
    assert dict(map(tuple, kinds.collect())) == {
        "id": "numeric", "price": "numeric", "key": "numeric", "priority": "categorical", "nothing": "unknown", "day": "datetime",
    }
    numbers = rows.select("id", "price")
    assert dict(map(tuple, drift._column_kinds(numbers, True).collect())) == {"id": "numeric", "price": "numeric"}


TEXTS = [
    "1-URGENT", "1", "-1.5e3", "+.5", "1e", "0x1p3", "0X1.8P1", "inf", "-Infinity", "NaN", "1f", "1d", "1,000", " 7 ", "7\t", "1_0",
    "2024", "12345", "2024-01-02", "2024-01-02 03:04:05", "2024/1/2", "13/1/2024", "1/13/2024", "1/1/24", "31/31/2024", "a/b/c", "", None,
    "12:30", "1 2", "١", "1\u0085", "e5", "--1", "1.2.3", "1/2/2024 x",
]


def test_texts_that_are_not_tried_would_not_have_parsed(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    text = F.trim("t")
    day = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")
    cast = F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))
    both = rows.select(
        "t", parse_timestamp(F.col("t")).eqNullSafe(day).alias("day"),
        text_to_number(F.col("t"), False).eqNullSafe(F.when(~F.isnan(cast), cast)).alias("number"),
    ).collect()
    assert [r["t"] for r in both if not r["day"]] == [] and [r["t"] for r in both if not r["number"]] == []


def test_texts_without_a_slash_are_not_tried_as_dates(spark):
    rows = spark.createDataFrame([("1-URGENT",)], "t string")
    assert plan(rows.select(parse_timestamp(F.col("t")))).lower().count("contains") >= len(DATE_FORMATS)
