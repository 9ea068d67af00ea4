"""Cross-validation of linear and ridge regression from one scan.

Squares and products around their means are all that least squares needs, and they merge.  One pass
gathers them per fold; the model of a fold is solved from the merged moments of the others, and
its own moments give RMSE and R² of that model without looking at a row again.  Only
MAE, which has no such form, takes a second scan, for all folds at once.

Rows with a missing target, feature or fold are left out.  What reaches the driver is one matrix of
features x features per fold; more than ``MOST_FOLDS`` folds are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.values import quoted, rounded
from tabloom.plans.moments import FIELDS, SALTS, Moments, merged

MOST_FOLDS = 1000


def fold_moments(df: DataFrame, columns: Sequence[str], fold: str = "fold") -> dict[int, list[np.ndarray]]:
    """Per fold the co-moments (``FIELDS``) of all columns over its complete rows."""
    k = len(columns)
    numbers = df.select(quoted(fold).cast("int").alias("fold"), *[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    numbers = numbers.dropna()  # NaN is missing, too
    names = ["fold", "salt", *FIELDS]
    arrays = ", ".join(f"{f} array<double>" for f in FIELDS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            if len(batch):
                folds = batch.column(0).to_numpy(zero_copy_only=False)
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                for f in np.unique(folds).tolist():
                    held.setdefault(f, Moments(k)).add(rows[folds == f])
        salt = TaskContext.get().partitionId() % SALTS
        for f, moments in held.items():
            cells = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in moments.fields()]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([salt], pa.int32()), *cells], names=names)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fields = merged([[np.asarray(x) for x in row] for row in rows[FIELDS].itertuples(index=False)])
        return pd.DataFrame({"fold": [int(rows["fold"].iloc[0])], "salt": [0], **{f: [x] for f, x in zip(FIELDS, fields)}})

    schema = f"fold int, salt int, {arrays}"
    parts = numbers.mapInArrow(collect, schema)
    merged_folds = parts.groupBy("fold", "salt").applyInPandas(merge, schema).groupBy("fold").applyInPandas(merge, schema)
    rows = merged_folds.limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    return {r["fold"]: [np.reshape(r[f], (k, k)) for f in FIELDS] for r in rows}


def _solved(fields: list[np.ndarray], penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; the target is the last column.

    The penalty weighs squared coefficients against the summed squares; collinear
    features get the shortest solution.
    """
    _, _, means, _, _, product = fields
    mean = means[0]
    left = product[:-1, :-1] + penalty * np.eye(len(mean) - 1)
    slopes = np.linalg.lstsq(left, product[:-1, -1], rcond=None)[0]
    return slopes, float(mean[-1] - slopes @ mean[:-1])


def _judged(fields: list[np.ndarray], slopes: np.ndarray, intercept: float) -> tuple[float, float | None]:
    """RMSE and R² of a model on the rows behind the moments."""
    n, _, means, _, _, product = fields
    count, mean, spread = n[0, 0], means[0], product[-1, -1]
    gap = mean[-1] - intercept - slopes @ mean[:-1]
    own = spread - 2 * slopes @ product[:-1, -1] + slopes @ product[:-1, :-1] @ slopes
    unexplained = max(float(own), 0.0) + count * float(gap) ** 2
    return float(np.sqrt(unexplained / count)), float(1 - unexplained / spread) if spread > 0 else None


def linear_folds(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", penalty: float = 0.0) -> DataFrame:
    """(fold, rows, coefficients, intercept, rmse, r2): each fold judged by the model of all others.

    R² is NULL where the target of a fold does not vary; fewer than two folds are an error.
    """
    parts = fold_moments(df, [*features, target], fold)
    if len(parts) < 2:
        raise ValueError("cross-validation needs two folds with complete rows")
    order = sorted(parts)
    # Merged moments before and after each fold: the others' from two merges.
    before, after = [None], [None]
    for f in order[:-1]:
        before.append(merged([p for p in (before[-1], parts[f]) if p]))
    for f in order[:0:-1]:
        after.append(merged([p for p in (after[-1], parts[f]) if p]))
    found = []
    for f, left, right in zip(order, before, reversed(after)):
        slopes, intercept = _solved(merged([p for p in (left, right) if p]), penalty)
        rmse, r2 = _judged(parts[f], slopes, intercept)
        found.append((f, int(parts[f][0][0, 0]), slopes.tolist(), intercept, rmse, r2))
    return df.sparkSession.createDataFrame(
        found, "fold int, rows bigint, coefficients array<double>, intercept double, rmse double, r2 double"
    )


def cross_validate_linear(
    df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", penalty: float = 0.0
) -> DataFrame:
    """(metric, mean, std, folds, higher_is_better) of MAE, RMSE and R²; std is the population one."""
    models = linear_folds(df, features, target, fold, penalty)
    values = [quoted(c).cast("double") for c in features]
    numbers = df.select(
        quoted(fold).cast("int").alias("fold"), F.array(*values).alias("x"), quoted(target).cast("double").alias("y")
    )
    whole = ~F.exists(F.array_append("x", F.col("y")), lambda v: v.isNull() | F.isnan(v))
    terms = F.zip_with("x", "coefficients", lambda a, b: a * b)
    residual = F.col("y") - F.aggregate(terms, F.col("intercept"), lambda s, t: s + t)
    # One row per fold.
    absolute = numbers.where(whole).join(F.broadcast(models), "fold").groupBy("fold").agg(F.avg(F.abs(residual)).alias("mae"))
    each = models.join(absolute, "fold").select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse", "r2")])
        ).alias("m")
    ).select("m.*")
    return each.groupBy("metric").agg(
        rounded(F.avg("value")).alias("mean"),
        rounded(F.stddev_pop("value")).alias("std"),
        F.count("*").alias("folds"),
        (F.col("metric") == "r2").alias("higher_is_better"),
    )
