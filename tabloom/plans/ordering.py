"""Global running sums and positions without a one-partition window.

The ordered domain is split at cut points; each piece is windowed on its own
and shifted by the total of the pieces before it.  Cut points come from a hash
threshold: a row is sampled if its hash is small enough, which needs no ordering, works
in every task by itself and is valid for any orderable type.  The share of sampled rows is the same in every group,
so a group gets as many pieces as its rows ask for.  The number of pieces follows the counted rows, without an upper limit.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_BUCKET = 16
ROWS_PER_PIECE = 500_000
LEAST_PIECES = 8
HASH_RANGE = 1 << 40


def pieces_of(rows: int) -> int:
    return max(LEAST_PIECES, rows // ROWS_PER_PIECE + 1)


def _cut_table(df: DataFrame, order: str, by: Sequence[str], pieces: int, rows: int) -> DataFrame:
    """One row per sampled group: the sorted cut points, in blocks of about their square root.

    All groups together have about one cut for each piece.  Without groups the row becomes a
    literal, so a re-run task sees the same pieces; with groups it stays a table.
    """
    share = min(1.0, pieces * SAMPLE_PER_BUCKET / max(1, rows))
    sample = df.select(*by, order).where(
        F.pmod(F.xxhash64(F.lit(29), order), F.lit(HASH_RANGE)) < F.lit(int(share * HASH_RANGE))
    )
    kept = F.array_sort(F.collect_set(order))
    cuts = F.filter(kept, lambda _, i: (i + 1) % SAMPLE_PER_BUCKET == 0)
    width = _width(pieces)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_flat") - 1, F.lit(0)), F.lit(width))
    blocks = F.transform(starts, lambda s: F.slice("_flat", s + 1, width))
    table = sample.groupBy(*by).agg(cuts.alias("_flat")).select(*by, blocks.alias("_cuts"))
    if by:
        return table
    kind = T.ArrayType(T.ArrayType(df.schema[order].dataType))
    return df.sparkSession.createDataFrame(table.collect(), T.StructType([T.StructField("_cuts", kind)]))


def _width(pieces: int) -> int:
    return max(1, math.isqrt(pieces))


def _with_piece(df: DataFrame, order: str, by: Sequence[str], pieces: int, rows: int) -> DataFrame:
    # Bounded: one cut for each ``ROWS_PER_PIECE`` rows of the whole table, whatever the groups.
    table = F.broadcast(_cut_table(df, order, by, pieces, rows))
    joined = df.join(table, list(by), "left") if by else df.crossJoin(table)
    # Two short searches: the last block that starts at or before the value, then inside it.
    block = F.size(F.filter("_cuts", lambda b: F.get(b, F.lit(0)) <= F.col(order)))
    inside = F.size(F.filter(F.get("_cuts", block - 1), lambda cut: cut <= F.col(order)))
    position = F.when(block > 0, (block - 1) * _width(pieces) + inside).otherwise(0)
    return joined.withColumn("_b", F.coalesce(position, F.lit(0))).drop("_cuts")


def _shifted(
    pieced: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str]
) -> DataFrame:
    names = list(sums)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = pieced.groupBy(*by, "_b").agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()]
    )
    offsets = totals.select(
        *by,
        "_b",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_o_" + n) for n in names],
    )
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = pieced.select(
        "*", *[F.sum(expr).over(inside).alias("_l_" + n) for n, expr in sums.items()]
    )
    # One row per piece; with groups adaptive execution decides by the real size.
    shifted = local.join(offsets if by else F.broadcast(offsets), [*by, "_b"], "left")
    for n in names:
        shifted = shifted.withColumn(n, F.col("_l_" + n) + F.col("_o_" + n))
    return shifted.drop("_b", *["_l_" + n for n in names], *["_o_" + n for n in names])


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Add inclusive running sums over ``order`` (unique within ``by``).

    The table is read three times (rows counted, cuts drawn, sums made): an aggregated one should be cut off first.
    """
    by, rows = list(by), df.count()
    pieces = pieces or pieces_of(rows)
    return _shifted(_with_piece(df, order, by, pieces, rows), [F.col(order)], sums, by)


def with_position(
    df: DataFrame, order_by: Sequence[str], pieces: int | None = None
) -> DataFrame:
    """Add the 0-based global position ``_pos`` by a unique row key."""
    keyed = df.withColumn("_k", F.struct(*[F.col(c) for c in order_by]))
    numbered = running_totals(keyed, "_k", {"_pos": F.lit(1)}, pieces=pieces)
    return numbered.withColumn("_pos", F.col("_pos") - 1).drop("_k")


def hash_position(
    df: DataFrame, seed: int, key: Sequence[str], by: Sequence[str] = (), name: str = "_pos",
    pieces: int | None = None,
) -> DataFrame:
    """0-based position in a seeded random order, within ``by`` groups.

    Pieces are ranges of the hash itself, so a class holding most of the rows
    is still spread over all of them.
    """
    bits = max(1, ((pieces or pieces_of(df.count())) - 1).bit_length())
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key]))
    pieced = hashed.withColumn("_b", F.shiftright("_h", 64 - bits))
    order = [F.col("_h"), *[F.col(c) for c in key]]
    numbered = _shifted(pieced, order, {name: F.lit(1)}, list(by))
    return numbered.withColumn(name, F.col(name) - 1).drop("_h")


def evenly_spaced(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Rows at positions floor(linspace(0, N-1, n)); every row when N <= n.

    ``order_by`` has to be a unique key; a NULL in it counts as a value.
    """
    spark = df.sparkSession
    size = df.agg(F.count("*").alias("_n"))
    if n <= 1:
        wanted = size.select(F.lit(0).cast("long").alias("_pos"))
    else:
        step = (F.col("_n") - 1) / F.lit(float(n - 1))
        spaced = F.when(F.col("id") == n - 1, F.col("_n") - 1).otherwise(
            F.floor(F.col("id") * step)
        )
        wanted = (
            spark.range(n)
            .crossJoin(F.broadcast(size))
            .select(
                F.when(F.col("_n") <= n, F.col("id")).otherwise(spaced).cast("long").alias("_pos")
            )
        )
    # Only the keys are shuffled; the n wanted keys (bounded by the argument) then
    # pick their rows in a second scan.
    names = {c: f"_k{i}" for i, c in enumerate(order_by)}
    keys = with_position(df.select(*order_by), order_by)
    kept = keys.join(F.broadcast(wanted.distinct()), "_pos").select(
        "_pos", *[F.col(c).alias(k) for c, k in names.items()]
    )
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    return df.join(F.broadcast(kept), same).select(*df.columns, "_pos")
