"""Trees fitted on cells of binned features against the same trees fitted on all rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators import supervised, tree_cells
from tabloom.operators.features import FeatureConfig

CONFIG = FeatureConfig(numeric=("a", "b"), categorical=("c",))


@pytest.fixture(scope="module")
def rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    a, b = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) / 10.0
    c = F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0, "x").otherwise("y")
    made = spark.range(8000).select("id", a.alias("a"), b.alias("b"), c.alias("c"), noise.alias("n"))
    y = 3 * F.col("a") + F.when((F.col("c") == "x") & (F.col("b") > 0.2), 40).otherwise(0) + F.col("n")
    return made.withColumn("y", y).withColumn("k", F.when(y < 60, "low").when(y < 110, "mid").otherwise("high")).localCheckpoint()


def both(rows, target, task, name, params, monkeypatch):
    prepared = supervised.prepare(supervised.labelled_rows(rows, target, task), CONFIG, task)
    monkeypatch.setattr(tree_cells, "LEAST_ROWS", 1)
    cells = tree_cells.cells_of(prepared.rows, prepared.stats.rows, params, 42)
    assert cells is not None and len(cells.codes) <= 32 * 5 * 2
    on_cells = supervised.fit_model(prepared, name, task, params=params)
    monkeypatch.setattr(tree_cells, "LEAST_ROWS", 10**9)
    on_rows = supervised.fit_model(prepared, name, task, params=params)
    assert len(on_cells.stages[0].stages) == 2 and len(on_cells.stages) == len(on_rows.stages)
    return cells, on_cells, on_rows


def predicted(model, rows):
    return supervised.predict(model, rows).orderBy("id").select("predicted").toPandas()["predicted"].to_numpy()


def test_boosted_trees_are_the_same(rows, monkeypatch, tmp_path):
    cells, on_cells, on_rows = both(rows, "y", "regression", "gbt_regressor", {"maxIter": 4}, monkeypatch)
    merged = cells.merged(False)
    assert merged.count() == len(cells.codes) and merged.agg(F.sum("weight")).first()[0] == 8000
    assert np.allclose(predicted(on_cells, rows), predicted(on_rows, rows), rtol=1e-9)
    assert np.allclose(on_cells.stages[1].featureImportances.toArray(), on_rows.stages[1].featureImportances.toArray())
    on_cells.write().save(str(tmp_path / "model"))
    assert np.allclose(predicted(PipelineModel.load(str(tmp_path / "model")), rows), predicted(on_cells, rows))


def test_boosted_classes_are_the_same(rows, monkeypatch):
    _, on_cells, on_rows = both(rows, "k", "classification", "gbt_classifier", {"maxIter": 3}, monkeypatch)
    assert (predicted(on_cells, rows) == predicted(on_rows, rows)).all()


def test_forest_draws_weights_per_row(rows, monkeypatch):
    cells, on_cells, on_rows = both(rows, "y", "regression", "random_forest_regressor", {"numTrees": 12, "maxDepth": 6}, monkeypatch)
    drawn = tree_cells._drawn(cells, 12, 42).groupBy("tree").agg(F.sum("weight").alias("w"), F.sum("total").alias("t")).toPandas()
    # A tree's weights add up to about the rows: Poisson, deviation sqrt(8000).
    assert len(drawn) == 12 and (abs(drawn["w"] - 8000) < 6 * 8000**0.5).all() and drawn["w"].nunique() > 1
    truth = rows.orderBy("id").toPandas()["y"].to_numpy()
    gaps = [np.sqrt(np.mean((predicted(m, rows) - truth) ** 2)) for m in (on_cells, on_rows)]
    assert gaps[0] < 1.25 * gaps[1] and on_cells.stages[1].getNumTrees == 12
    assert np.allclose(sum(on_cells.stages[1].featureImportances.toArray()), 1.0)


def test_values_that_never_repeat_share_bins(spark, monkeypatch):
    rows = spark.range(6000).select("id", (F.rand(1) * 100).alias("a"), F.rand(2).alias("b"), F.lit("x").alias("c"))
    rows = rows.withColumn("y", F.col("a") * 2 + F.when(F.col("b") > 0.5, 30).otherwise(0)).localCheckpoint()
    monkeypatch.setattr(tree_cells, "SHARE", 2)
    prepared = supervised.prepare(supervised.labelled_rows(rows, "y", "regression"), CONFIG, "regression")
    monkeypatch.setattr(tree_cells, "LEAST_ROWS", 1)
    cells = tree_cells.cells_of(prepared.rows, 6000, None, 42)
    assert 900 < len(cells.codes) <= 1024
    model = supervised.fit_model(prepared, "gbt_regressor", "regression", params={"maxIter": 20})
    found = supervised.predict(model, rows).agg(F.corr("y", "predicted")).first()[0]
    assert found > 0.97


def test_many_features_and_other_settings_keep_the_rows(rows, monkeypatch):
    monkeypatch.setattr(tree_cells, "LEAST_ROWS", 1)
    prepared = supervised.prepare(supervised.labelled_rows(rows, "y", "regression"), CONFIG, "regression")
    assert tree_cells.cells_of(prepared.rows, 8000, {"minInstancesPerNode": 5}, 42) is None
    monkeypatch.setattr(tree_cells, "MOST_FEATURES", 2)
    assert tree_cells.cells_of(prepared.rows, 8000, None, 42) is None


def test_cut_points():
    assert tree_cells.cut_points(np.array([3.0, 1.0, 3.0, 2.0])) == [1.5, 2.5]
    assert tree_cells.cut_points(np.array([])) == []
    cuts = tree_cells.cut_points(np.arange(1000.0))
    assert len(cuts) == 31 and np.ptp(np.diff(cuts)) <= 1
