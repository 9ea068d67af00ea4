"""Drawn rows: the draws Spark's hash gives, whatever the packs, chunks and lanes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.plans import draws, packed


def test_draws_are_those_of_the_hash(spark):
    rows = [(None, "a"), (5, None), (-(2**62), "ä"), (0, ""), (7, "x" * 50)]
    df = spark.createDataFrame(rows, "k long, s string")
    for n in (1, 2, 10, 999_983, 2**40):
        wanted = [F.pmod(F.xxhash64(F.lit(43), "k", "s", F.lit(t)), F.lit(n)).alias(f"t{t}") for t in range(13)]
        found = df.select(F.xxhash64(F.lit(43), "k", "s").alias("h"), *wanted).collect()
        got = draws.hashed_draws(np.array([r["h"] for r in found]), 13, n)
        assert got.tolist() == [list(r[1:]) for r in found]


def test_numbers_come_back():
    for numbers in ([0], [3, 3, 9, 300, 70_000, 2**31], np.arange(1000) * 17):
        assert np.array_equal(draws._numbers(*draws._steps(np.array(numbers))), numbers)


@pytest.mark.parametrize("size, pack, lane", [(1000, 1 << 21, 1 << 23), (7, 60, 40), (100, 3, 20)])
def test_rows_meet_what_they_drew(spark, monkeypatch, size, pack, lane):
    monkeypatch.setattr(packed, "CHUNK_ROWS", (size, size))
    monkeypatch.setattr(draws, "PACK_DRAWS", pack)
    monkeypatch.setattr(draws, "CHUNK_DRAWS", lane)
    n = 211
    numbered = spark.createDataFrame([(i, None if i % 9 == 0 else i * 0.5, f"b{i}") for i in range(n)], "_pos long, x double, `y z` string")
    asking = spark.createDataFrame([(i % 90, f"a{i}") for i in range(130)], "k int, own string").repartition(5)
    found = draws.with_draws(asking, F.xxhash64(F.lit(8), "k"), 6, numbered.repartition(3), {"x": "_x", "y z": "_y"})
    assert found.columns == ["k", "own", "t", "_x", "_y"]
    wanted = asking.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn(
        "_pos", F.pmod(F.xxhash64(F.lit(8), "k", "t"), F.lit(n))
    ).join(numbered, "_pos").select("k", "own", "t", "x", "y z")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))
    assert draws.with_draws(asking, F.xxhash64(F.lit(8), "k"), 6, numbered.limit(0), {"x": "_x"}).count() == 0
    assert draws.with_draws(asking.limit(0), F.xxhash64(F.lit(8), "k"), 6, numbered, {"x": "_x"}).count() == 0


def test_draws_are_not_sent_as_rows(spark):
    numbered = spark.range(5_000).select(F.col("id").alias("_pos"), (F.col("id") * 0.5).alias("x"))
    asking = spark.range(3_000).withColumnRenamed("id", "k")
    found = draws.with_draws(asking, F.xxhash64(F.lit(8), "k"), 10, numbered, {"x": "_x"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and found.count() == 30_000
