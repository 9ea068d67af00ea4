"""Shared kernels agree with plain Python."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.eda import correlation_pairs
from tabloom.plans.graphs import connected_components
from tabloom.plans.ordering import _cut_table, evenly_spaced, hash_position, running_totals, with_position
from tabloom.plans.quantiles import long_quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def values(kind, n):
    rng = np.random.default_rng(7)
    if kind == "smooth":
        return rng.normal(size=n)
    if kind == "ties":
        return np.floor(rng.normal(size=n) * 3)
    hot = rng.normal(size=n)
    hot[: n // 3] = 1.25  # a third of all rows
    return hot


@pytest.mark.parametrize("kind", ["smooth", "ties", "hot"])
@pytest.mark.parametrize("n", [1, 2, 5, 399, 20_011])
def test_quantiles_are_exact(spark, kind, n):
    v = values(kind, n)
    long = spark.createDataFrame(pd.DataFrame({"column": "a", "value": v})).repartition(7)
    expected = np.quantile(v, PROBABILITIES)
    got = long_quantiles(long, PROBABILITIES, accuracy=2000).first()["q"]
    assert np.allclose(got, expected, atol=1e-12), (kind, n)


def test_long_table_is_not_shuffled_by_column(spark):
    long = spark.range(1000).select(F.lit("a").alias("column"), F.col("id").cast("double").alias("value"))
    plan = long_quantiles(long, [0.25, 0.5])._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    raw = [k for k in keys if "_v" in k]
    assert raw and all("_piece" in k for k in raw) and "SortMergeJoin" not in plan


def test_quantiles_by_group(spark):
    frame = pd.DataFrame({"g": [f"g{i % 3}" for i in range(9000)], "value": values("hot", 9000)})
    long = spark.createDataFrame(frame).repartition(5)
    expected = frame.groupby("g")["value"].quantile([0.3, 0.6]).unstack()
    rows = long_quantiles(long, [0.3, 0.6], ["g"], accuracy=500).collect()
    assert len(rows) == 3
    for r in rows:
        assert np.allclose(r["q"], expected.loc[r["g"]].to_numpy())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_agree(spark, by):
    frame = pd.DataFrame({"g": [i % 2 for i in range(3000)], "k": range(3000), "w": [i % 5 for i in range(3000)]})
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(6)
    expected = frame.groupby("g")["w"].cumsum() if by else frame["w"].cumsum()
    for pieces in (None, 1, 40, 100, 1500):
        got = running_totals(df, "k", {"s": F.col("w")}, by, pieces).orderBy("k").toPandas()
        assert got["s"].tolist() == expected.tolist()


def test_groups_are_cut_without_ordering_them(spark):
    """Cuts follow the rows of a group, and no window holds a whole one."""
    df = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 200)).alias("g"), "id")
    cuts = {r["g"]: sum(map(len, r["_cuts"])) for r in _cut_table(df, "id", ["g"], 100, 40_000).collect()}
    assert 55 <= cuts["hot"] <= 95 and all(n <= 3 for g, n in cuts.items() if g != "hot")
    plan = _cut_table(df, "id", ["g"], 100, 40_000)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    whole = running_totals(df, "id", {"n": F.lit(1)}, ["g"], 100)
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", whole._jdf.queryExecution().executedPlan().toString())
    assert any("_b" in w and "g#" in w for w in windows) and not any(re.fullmatch(r"g#\d+", w) for w in windows if "id" in w)


def test_positions_for_text_and_composite_keys(spark):
    frame = pd.DataFrame({"a": [f"k{i % 13:02d}" for i in range(1000)], "b": range(1000)})
    df = spark.createDataFrame(frame.sample(frac=1, random_state=3)).repartition(7)
    expected = frame.sort_values(["a", "b"])["b"].tolist()
    for pieces in (None, 1, 40):
        got = with_position(df, ["a", "b"], pieces).orderBy("_pos").toPandas()
        assert got["b"].tolist() == expected
        assert got["_pos"].tolist() == list(range(1000))


def test_hash_positions_are_dense_and_ignore_partitions(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold"))
    one = hash_position(df.repartition(1), 5, ["id"], ["g"]).toPandas()
    many = hash_position(df.repartition(7), 5, ["id"], ["g"]).toPandas()
    assert one.sort_values("id")["_pos"].tolist() == many.sort_values("id")["_pos"].tolist()
    for _, part in one.groupby("g"):
        assert sorted(part["_pos"]) == list(range(len(part)))


def _wide_table(spark, k, rows):
    """Far from zero, with gaps, a constant and an all-missing column."""
    rng = np.random.default_rng(6)
    shared = rng.normal(size=rows)
    data = np.column_stack([1e6 * (i % 3) + shared * (i % 5) + rng.normal(size=rows) for i in range(k)])
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 3], data[:, 5] = 7.0, np.nan
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(k)])
    columns = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame.columns]
    return frame, spark.createDataFrame(frame).select(*columns).repartition(7)


def test_correlations_of_all_pairs(spark):
    frame, df = _wide_table(spark, 30, 900)
    expected = frame.corr().to_numpy()
    rows = correlation_pairs(df, df.columns).collect()
    assert len(rows) == 30 * 29 // 2
    for r in rows:
        want = expected[r["i"], r["j"]]
        assert (r["column_a"], r["column_b"]) == (f"c{r['i']}", f"c{r['j']}")
        assert r["correlation"] is None if np.isnan(want) else abs(r["correlation"] - want) < 6e-5


def test_many_columns_are_scanned_once(spark, tmp_path):
    frame, df = _wide_table(spark, 150, 400)
    df.write.parquet(str(tmp_path / "wide"))
    found = correlation_pairs(spark.read.parquet(str(tmp_path / "wide")), list(frame.columns))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    expected = frame.corr().to_numpy()
    for r in found.collect():
        want = expected[r["i"], r["j"]]
        assert r["correlation"] is None if np.isnan(want) else abs(r["correlation"] - want) < 6e-5


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(30)))
    assert correlation_pairs(df, df.columns[:1]).count() == 0
    assert all(r["correlation"] is None for r in correlation_pairs(df, df.columns).collect())


@pytest.mark.parametrize("size,n", [(5, 10), (10, 10), (101, 10), (1000, 7), (50, 1)])
def test_evenly_spaced_matches_linspace(spark, size, n):
    got = sorted(r["id"] for r in evenly_spaced(spark.range(size), n, ["id"]).collect())
    expected = range(size) if size <= n else np.linspace(0, size - 1, n, dtype=int)
    assert got == sorted(set(int(i) for i in expected))


def test_evenly_spaced_keeps_a_null_key(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert {r["v"] for r in evenly_spaced(df, 3, ["k"]).collect()} == {"x", "y", "z"}


def _roots(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 900, (500, 2))] + [(5000, 5000), (5001, 5001)]
    df = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(5)
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == _roots(pairs)
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    """A chain of 1,000 nodes in mixed order, and a hub with 100,000 neighbours."""
    chain = spark.range(0, 999, 1, 2).select((F.col("id") * 7919 % 1_000).alias("u"), ((F.col("id") + 1) * 7919 % 1_000).alias("v"))
    hub = spark.range(0, 100_000, 1, 2).select(F.lit(60_000).cast("long").alias("u"), (F.col("id") + 1_001).alias("v"))
    got = connected_components(chain.unionByName(hub)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: 1_000, 1_001: 100_000}
