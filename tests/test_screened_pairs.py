"""Screened matrix products decide like plain differences; rows are sent to a bounded number of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbours, unsupervised
from tests.test_models import cloud, to_frame


def awkward(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 5))
    if kind == "far from zero":
        return rows * 1e-4 + 1e6
    if kind == "lattice":  # nearly all distances tie
        return rng.integers(0, 2, size=(300, 5)).astype(float)
    if kind == "tiny":
        return rows * 1e-170
    if kind == "not finite":
        rows[7, 2], rows[9, 0], rows[11] = np.inf, np.nan, 1e200
    return rows


@pytest.mark.parametrize("kind", ["plain", "far from zero", "lattice", "tiny", "not finite"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_tiles_match_plain_differences(kind, monkeypatch):
    rows = awkward(kind)
    monkeypatch.setattr(neighbours, "SCREEN_CELLS", 7_000)  # several tiles
    plain = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    gaps = np.round(plain, neighbours.DIGITS)
    qi, bi, found = neighbours.nearest_pairs(rows, rows, 2)
    want = np.argsort(gaps, axis=1, kind="stable")[:, :2]
    assert (qi == np.repeat(np.arange(300), 2)).all() and (bi.reshape(300, 2) == want).all()
    assert np.array_equal(found.reshape(300, 2), np.take_along_axis(gaps, want, axis=1), equal_nan=True)
    eps = float(plain[0, 5])  # on the border
    near = np.concatenate([part for _, part in neighbours.within(rows, rows, eps)])
    assert (near == (plain <= eps)).all()


def test_rows_are_sent_to_few_blocks(spark):
    df = to_frame(spark, np.random.default_rng(0).normal(size=(2000, 4)))
    blocks = neighbours.pair_blocks(df, df, block_rows=20)
    for side in (blocks.queries, blocks.base):
        assert side.count() <= 2000 * neighbours.BLOCKS_A_SIDE


def test_silhouette_matches_brute_force(spark):
    rows = cloud(120, 3) + 1e4
    labels = np.arange(120) % 3
    gaps = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    means = np.stack([gaps[:, labels == c].sum(axis=1) for c in range(3)], axis=1)
    own = means[np.arange(120), labels] / 39
    other = np.where(np.eye(3)[labels] > 0, np.inf, means / 40).min(axis=1)
    want = ((other - own) / np.maximum(own, other)).mean()
    df = to_frame(spark, rows, label=labels).withColumn("label", F.col("label").cast("int"))
    assert unsupervised.silhouette(df, block_rows=30).first()[0] == pytest.approx(want, abs=6e-5)
