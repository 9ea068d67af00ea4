"""Catalyst's own size estimate, used only to share a small input among the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPREAD_BYTES = (2 * 1024 * 1024, 256 * 1024 * 1024)


def estimated_bytes(df: DataFrame) -> int:
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        return int(str(plan.stats().sizeInBytes()))
    except Exception:  # no JVM handle (remote session): treat as large
        return 1 << 62


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a small table that sits in few files among all cores.

    A file with one row group is one task.  Below the upper bound a shuffle of
    the needed columns costs less than the idle cores; larger tables have enough
    splits and are never shuffled here.  The plan above is the same either way, and
    a wrong estimate costs one needless or one missed shuffle, nothing else.
    """
    least, most = SPREAD_BYTES
    if not least <= estimated_bytes(df) <= most:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
