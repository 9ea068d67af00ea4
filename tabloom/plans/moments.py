"""Pairwise-complete co-moments of many columns from one scan.

Every task holds square matrices over the columns (rows where both are present, and their
sums, squares and products around the task's own centre) and gives them out in blocks of pairs.  Blocks of the same pairs are
then merged around their common means, first by ``SALTS`` shares of the tasks and then over those, so no
group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # columns of a block: 64 x 64 pairs
SALTS = 256
FIELDS = ["n", "mean_a", "mean_b", "square_a", "square_b", "product"]


class Moments:
    """Co-moments of all pairs of k columns around a fixed centre."""

    def __init__(self, k: int):
        self.centre: np.ndarray | None = None
        self.n, self.sums, self.squares, self.products = (np.zeros((k, k)) for _ in range(4))

    def add(self, rows: np.ndarray) -> None:
        """Rows by columns; NaN is missing."""
        here = ~np.isnan(rows)
        if self.centre is None:
            counts = here.sum(axis=0)
            self.centre = np.where(counts > 0, np.where(here, rows, 0).sum(axis=0) / np.maximum(counts, 1), 0.0)
            self.centre[~np.isfinite(self.centre)] = 0.0
        gaps = np.where(here, rows - self.centre, 0.0)
        mask = here.astype(float)
        self.n += mask.T @ mask
        self.sums += gaps.T @ mask  # of the first column, where the second is there too
        self.squares += (gaps * gaps).T @ mask
        self.products += gaps.T @ gaps

    def fields(self) -> list[np.ndarray]:
        """``FIELDS`` as matrices: means as such, the rest around them."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(self.n > 0, self.sums / self.n, 0.0)
        centre = np.zeros(len(self.n)) if self.centre is None else self.centre
        return [
            self.n, mean + centre[:, None], mean.T + centre[None, :], self.squares - self.sums * mean,
            (self.squares - self.sums * mean).T, self.products - self.sums * mean.T,
        ]


def merged(parts: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """Fields of several parts as those of all their rows."""
    n, mean_a, mean_b, square_a, square_b, product = (np.asarray(x, float).copy() for x in parts[0])
    for m, a, b, aa, bb, ab in parts[1:]:
        both = n + m
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(both > 0, m / both, 0.0)
        gap_a, gap_b = a - mean_a, b - mean_b
        square_a += aa + gap_a * gap_a * n * share
        square_b += bb + gap_b * gap_b * n * share
        product += ab + gap_a * gap_b * n * share
        mean_a, mean_b, n = mean_a + gap_a * share, mean_b + gap_b * share, both
    return [n, mean_a, mean_b, square_a, square_b, product]


def pair_moments(numbers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, n, mean_a … product) for all columns i < j of a frame of doubles."""
    k = len(numbers.columns)
    arrays = ", ".join(f"{f} array<double>" for f in FIELDS)
    starts = range(0, k, block)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments(k)
        for batch in batches:
            if len(batch):
                held.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        if held.centre is None:
            return
        fields = held.fields()
        salt = TaskContext.get().partitionId() % SALTS
        for a in starts:
            rows = [(a, b, salt, *[f[a : a + block, b : b + block].ravel() for f in fields]) for b in starts if b >= a]
            kinds = [pa.int32()] * 3 + [pa.list_(pa.float64())] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "salt", *FIELDS])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fields = merged([[np.asarray(x) for x in row] for row in rows[FIELDS].itertuples(index=False)])
        return pd.DataFrame({**{n: [int(rows[n].iloc[0])] for n in ("a", "b", "salt")}, **{f: [x] for f, x in zip(FIELDS, fields)}})

    schema = f"a int, b int, salt int, {arrays}"
    parts = numbers.mapInArrow(collect, schema)
    whole = parts.groupBy("a", "b", "salt").applyInPandas(merge, schema).groupBy("a", "b").applyInPandas(merge, schema)
    wide = F.least(F.lit(block), F.lit(k) - F.col("b"))
    cells = whole.select("a", "b", F.posexplode(F.arrays_zip(*FIELDS)).alias("p", "m"))
    return (
        cells.select(
            (F.col("a") + F.floor(F.col("p") / wide)).cast("int").alias("i"),
            (F.col("b") + F.col("p") % wide).cast("int").alias("j"), "m.*",
        )
        .where("i < j")
    )


def correlation() -> Column:
    """Pearson's coefficient of a row of ``pair_moments``; NULL without rows, not a number without spread."""
    spread = F.sqrt(F.greatest(F.col("square_a"), F.lit(0.0)) * F.greatest(F.col("square_b"), F.lit(0.0)))
    return F.when(F.col("n") > 0, F.col("product") / F.when(spread > 0, spread).otherwise(F.lit(float("nan"))))
