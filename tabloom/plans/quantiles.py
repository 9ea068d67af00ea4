"""Exact linear-interpolated quantiles, per column and optional group.

A sketch brackets each wanted rank and everything outside the brackets is folded onto
bracket ends (which keeps the order), so repeated values and far values cost one
row each.  The brackets, one row per column, are broadcast: the long table is never
shuffled by its column name.  What lies inside is split once more into ``PIECES``
steps of value per bracket; running counts over the pieces and then inside each piece
give the ranks, so no window holds a whole column.  A rank outside its bracket
raises instead of giving a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
PIECES = 64
SALTS = 32


def long_quantiles(
    long: DataFrame,
    probabilities: Sequence[float],
    by: Sequence[str] = ("column",),
    value: str = "value",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """(by…, q array) from non-NULL doubles in ``value``."""
    by, wanted = list(by), [float(p) for p in probabilities]
    return _at_ranks(_folded_counts(long, wanted, by, value, accuracy), wanted, by)


def _few_groups(by: list[str]) -> bool:
    """Grouped by nothing but the column name: as many rows as the table has columns."""
    return set(by) <= {"column"}


def _with_brackets(long: DataFrame, sketch: DataFrame, by: list[str], value: str) -> DataFrame:
    if not by:
        return long.select(value).crossJoin(F.broadcast(sketch))
    if _few_groups(by):
        return long.select(*by, value).join(F.broadcast(sketch), by)
    # Any number of groups, some of them hot: the join is dealt out by value as well.
    salted = long.select(*by, value, F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int").alias("_salt"))
    copies = sketch.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*by, "_salt"]).drop("_salt")


def _folded_counts(
    long: DataFrame, wanted: list[float], by: list[str], value: str, accuracy: int
) -> DataFrame:
    margin = 4.0 / accuracy
    low = [max(0.0, p - margin) for p in wanted]
    high = [min(1.0, p + margin) for p in wanted]
    sketch = long.groupBy(*by).agg(
        F.percentile_approx(value, F.array(*map(F.lit, low + high)), accuracy).alias("_s"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.count(value).alias("_rows"),
    )
    joined = _with_brackets(long, sketch, by, value)
    v, k = f"`{value}`", len(wanted)
    # The outermost ranks are bracketed by the true extremes.  With fewer values
    # than the sketch resolves, a bracket may be narrower than one rank: keep all.
    brackets = " OR ".join(f"(_s[{i}] <= {v} AND {v} <= _s[{k + i}])" for i in range(k))
    inside = f"(_rows <= {accuracy} OR {v} = _min OR {v} = _max OR {brackets})"
    below = ", ".join(f"CASE WHEN _s[{k + i}] < {v} THEN _s[{k + i}] END" for i in range(k))
    folded = F.expr(f"CASE WHEN {inside} THEN {v} ELSE greatest(_min, {below}) END")
    outside = F.expr(f"CAST(NOT {inside} AS INT)")
    # Each bracket adds 0 … PIECES as the value passes through it: never falls with the value.
    steps = [
        f"CASE WHEN _v >= _s[{k + i}] THEN {PIECES} WHEN _v > _s[{i}] AND _s[{k + i}] - _s[{i}] < double('Infinity') "
        f"THEN CAST(least({PIECES}, floor({PIECES} * ((_v - _s[{i}]) / (_s[{k + i}] - _s[{i}])))) AS INT) ELSE 0 END"
        for i in range(k)
    ]
    return (
        joined.select(*by, folded.alias("_v"), outside.alias("_out"), "_s")
        .select(*by, "_v", "_out", F.expr(" + ".join(steps)).alias("_piece"))
        .groupBy(*by, "_piece", "_v", "_out")
        .agg(F.count("*").alias("_c"))
    )


def _at_ranks(counts: DataFrame, wanted: list[float], by: list[str]) -> DataFrame:
    # At most PIECES + 1 rows per rank and group.
    pieces = counts.groupBy(*by, "_piece").agg(F.sum("_c").alias("_pc"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *by, "_piece", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_pc").over(whole).alias("_n"),
    )
    upto = Window.partitionBy(*by, "_piece").orderBy("_v", "_out").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = counts.select(*by, "_piece", "_v", "_out", "_c", F.sum("_c").over(upto).alias("_in"))
    ranked = inside.join(F.broadcast(offsets) if _few_groups(by) else offsets, [*by, "_piece"]).withColumn(
        "_to", F.col("_before") + F.col("_in")
    )

    # Written as SQL text: one round trip to the JVM per rank instead of a dozen.
    ranks = [f"({p!r}D * (_n - 1))" for p in wanted]
    exact = "CASE WHEN _out = 0 THEN _v ELSE CAST(raise_error('rank outside its bracket') AS DOUBLE) END"
    picks = [
        F.expr(
            f"max(CASE WHEN _to - _c <= {snap}({rank}) AND {snap}({rank}) < _to THEN {exact} END)"
            f" AS _{snap}{i}"
        )
        for i, rank in enumerate(ranks)
        for snap in ("floor", "ceil")
    ]
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    values = ", ".join(
        f"CASE WHEN {rank} = floor({rank}) THEN _floor{i} ELSE "
        f"_floor{i} + ({rank} - floor({rank})) * (_ceil{i} - _floor{i}) END"
        for i, rank in enumerate(ranks)
    )
    return picked.select(*by, F.expr(f"array({values}) AS q"))


def bucket_of(value: Column, edges: Column) -> Column:
    """Index of the half-open interval of sorted ``edges``; the last one is closed."""
    passed = F.size(F.filter(edges, lambda e: e <= value))
    return F.least(passed, F.size(edges) - 1)
