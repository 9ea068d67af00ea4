"""Tree ensembles on cells: rows whose binned features are equal become one weighted row.

Spark's trees bin every feature (``maxBins``, cut points from a sample) before they look for a split, so rows in
the same bins always go the same way.  A variance split only depends on the sums of weights and labels on its sides:
the spread inside a cell is the same on both sides of the comparison and cancels.  So boosted trees for squared
loss, fitted on one row per cell with its mean label and its weight, are those fitted on all rows; a classifier
keeps one row per cell and label.  A forest draws its Poisson weights for each row and tree, then sums them by cell.

There are at most ``maxBins`` bins per feature, whatever the values are.  Many features make about as many cells as
rows; then ``cells_of`` returns None and the rows themselves are used.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, shared_folder

BINS = 32  # Spark's default maxBins
SAMPLE_ROWS = 10_000  # as Spark's own sample for cut points
LEAST_ROWS = 50_000  # fewer rows are trained as they are
LEAST_CELLS = 32
MOST_CELLS = 1 << 15
MOST_FEATURES = 12  # their bins fit one long
SHARE = 8  # rows per cell that make cells worth it
TREES_AT_ONCE = 8
# Settings that mean the same on cells; any other leaves the rows as they are.
SETTINGS = {"numTrees", "maxDepth", "maxIter", "stepSize"}


def cut_points(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Spark's candidate splits: midpoints of all distinct values, or about equally filled bins."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < bins:
        return middles.tolist()
    stride = counts.sum() / bins
    found, target, before = [], stride, counts[0]
    for middle, count in zip(middles, counts[1:]):
        if abs(before - target) < abs(before + count - target):
            found.append(float(middle))
            target += stride
        before += count
    return found[: bins - 1]


def _bin(value: Column, cuts: Sequence[float], least: int = 0) -> Column:
    """Number of cut points below the value, by halving."""
    if not cuts:
        return F.lit(least)
    half = len(cuts) // 2
    return F.when(value > cuts[half], _bin(value, cuts[half + 1 :], least + half + 1)).otherwise(
        _bin(value, cuts[:half], least)
    )


class FeatureBins(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces every entry of ``features`` by the number of its bin."""

    cuts = Param(Params._dummy(), "cuts", "cut points of each feature", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, cuts=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def numbers(self, values: Column) -> list[Column]:
        return [_bin(values[i], cuts) for i, cuts in enumerate(self.getOrDefault("cuts"))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = dataset.schema["features"].metadata
        binned = F.array(*[n.cast("double") for n in self.numbers(F.col("_values"))])
        opened = dataset.withColumn("_values", vector_to_array("features"))
        return opened.withColumn("features", array_to_vector(binned).alias("features", metadata=kept)).drop("_values")


@dataclass
class Cells:
    """Cell number of each row (``cell, label, weight``), and what turns a number into features."""

    bins: FeatureBins
    rows: DataFrame
    codes: np.ndarray  # the numbers in use, sorted
    metadata: Mapping[str, Any]

    def features(self, cell: Column) -> Column:
        sizes = [len(c) + 1 for c in self.bins.getOrDefault("cuts")]
        steps = accumulate([1, *sizes[:-1]], lambda a, b: a * b)
        digits = [F.pmod(F.expr(f"cell div {step}"), F.lit(size)).cast("double") for step, size in zip(steps, sizes)]
        return array_to_vector(F.array(*digits)).alias("features", metadata=self.metadata)

    def merged(self, by_label: bool) -> DataFrame:
        """(features, label, weight): one row per cell, and label if ``by_label``."""
        if by_label:
            found = self.rows.groupBy("cell", "label").agg(F.sum("weight").alias("weight"))
        else:
            found = self.rows.groupBy("cell").agg(
                (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight")
            )
        ready = found.where("weight > 0").select(self.features(F.col("cell")), "label", "weight")
        # At most some ten thousand rows, read several times per tree: one task is faster than many.
        return cut_lineage(ready.coalesce(1))


def cells_of(rows: DataFrame, count: int, params: Mapping[str, Any] | None, seed: int) -> Cells | None:
    """The cells of prepared rows, or None where they would not make the work smaller."""
    metadata = rows.schema["features"].metadata
    attributes = metadata.get("ml_attr", {})
    size, kinds = attributes.get("num_attrs", 0), attributes.get("attrs", {})
    if count < LEAST_ROWS or not 0 < size <= MOST_FEATURES or set(params or {}) - SETTINGS or set(kinds) - {"numeric", "binary"}:
        return None
    binary = {entry["idx"] for entry in kinds.get("binary", [])}
    values = vector_to_array("features")
    drawn = rows.select(values.alias("v")).sample(False, min(1.0, max(BINS**2, SAMPLE_ROWS) / count), seed).collect()
    table = np.array([r["v"] for r in drawn]).reshape(-1, size)
    table = np.where(np.isfinite(table), table, np.nan)
    cuts = [[0.5] if i in binary else cut_points(table[~np.isnan(table[:, i]), i]) for i in range(size)]
    seen = {tuple(bisect_left(c, v) for c, v in zip(cuts, row)) for row in table.tolist()}
    if len(seen) * 2 > len(table):
        return None
    bins = FeatureBins(cuts=cuts)
    steps = accumulate([1, *[len(c) + 1 for c in cuts[:-1]]], lambda a, b: a * b)
    number = sum((n.cast("long") * step for n, step in zip(bins.numbers(F.col("_v")), steps)), F.lit(0).cast("long"))
    placed = rows.withColumn("_v", values).select(number.alias("cell"), F.col("label").cast("double").alias("label"), "weight")
    codes = placed.select("cell").distinct().limit(MOST_CELLS + 1).toPandas()["cell"].to_numpy()
    if not LEAST_CELLS <= len(codes) <= min(MOST_CELLS, count // SHARE):
        return None
    return Cells(bins, placed, np.sort(codes), metadata)


def _drawn(cells: Cells, trees: int, seed: int) -> DataFrame:
    """(tree, cell, weight, total): Poisson weights of every row in every tree, summed by cell."""
    codes = cells.codes

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows are a checkpoint, so a task that is repeated draws the same.
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        weight, total = np.zeros((2, trees, len(codes)))
        for batch in batches:
            at = np.searchsorted(codes, batch.column(0).to_numpy())
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for tree in range(trees):
                times = random.poisson(1.0, len(at))
                weight[tree] += np.bincount(at, times, len(codes))
                total[tree] += np.bincount(at, times * label, len(codes))
        for tree in range(trees):
            used = np.flatnonzero(weight[tree])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), tree, np.int32)), pa.array(codes[used]), pa.array(weight[tree][used]),
                     pa.array(total[tree][used])],
                    names=["tree", "cell", "weight", "total"],
                )

    sums = cells.rows.select("cell", "label").mapInArrow(draw, "tree int, cell bigint, weight double, total double")
    return sums.groupBy("tree", "cell").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def forest_regressor(cells: Cells, estimator: RandomForestRegressor, seed: int) -> RandomForestRegressionModel:
    """A forest whose trees are fitted side by side, each on its own weighted cells."""
    spark, trees = cells.rows.sparkSession, estimator.getNumTrees()
    folder = f"{shared_folder(spark)}/forest"
    rows = _drawn(cells, trees, seed).select("tree", "cell", (F.col("total") / F.col("weight")).alias("label"), "weight")
    rows.repartition(TREES_AT_ONCE, "tree").write.partitionBy("tree").parquet(folder)
    one = estimator.copy().setParams(
        numTrees=1, bootstrap=False, weightCol="weight", featureSubsetStrategy="onethird" if trees > 1 else "all"
    )

    def fit(tree: int):
        own = spark.read.schema("cell bigint, label double, weight double").parquet(f"{folder}/tree={tree}")
        ready = own.select(cells.features(F.col("cell")), "label", "weight").coalesce(1)
        return one.copy({one.seed: seed + tree}).fit(ready)

    with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as pool:
        fitted = list(pool.map(inheritable_thread_target(spark)(fit), range(trees)))
    context = spark.sparkContext
    regression = context._jvm.org.apache.spark.ml.regression
    members = context._gateway.new_array(regression.DecisionTreeRegressionModel, trees)
    for i, model in enumerate(fitted):
        members[i] = model._java_obj.trees()[0]
    joined = RandomForestRegressionModel(regression.RandomForestRegressionModel(estimator.uid, members, fitted[0].numFeatures))
    return estimator._copyValues(joined)
