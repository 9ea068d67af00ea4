"""DBSCAN by pieces: the clusters of brute force, and no second look at what a dense region has settled."""

import numpy as np
import pytest

from tabloom.operators import unsupervised
from tests.test_models import to_frame


def brute(rows, eps, least):
    near = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    labels = np.full(len(rows), -1)
    for i in range(len(rows)):
        if core[i] and labels[i] == -1:
            label, stack = labels.max() + 1, [i]
            while stack:
                j = stack.pop()
                if labels[j] == -1:
                    labels[j] = label
                    stack += np.flatnonzero(near[j] & core & (labels == -1)).tolist()
    for i in np.flatnonzero(~core):
        labels[i] = labels[near[i] & core].min(initial=len(rows))
    return np.where(labels == len(rows), -1, labels)


def shapes(kind):
    rng = np.random.default_rng(6)
    if kind == "blobs":  # several pieces of every size, border points, noise, copies
        centres = rng.uniform(-6, 6, (7, 3))
        rows = np.concatenate([c + rng.normal(0, 0.4, (n, 3)) for c, n in zip(centres, (300, 200, 90, 40, 12, 5, 4))])
        return np.concatenate([rows, rng.uniform(-9, 9, (60, 3)), rows[:30], rows[:5]]), 0.45, 6
    if kind == "chain":  # one cluster that drawn points only know in parts
        return np.column_stack([np.arange(400) * 0.1, np.zeros(400)]), 0.11, 3
    if kind == "one":
        return rng.normal(0, 1, (500, 4)), 1.5, 4
    return rng.uniform(-50, 50, (300, 3)), 0.5, 3  # noise only


@pytest.mark.parametrize("kind", ["blobs", "chain", "one", "noise"])
@pytest.mark.parametrize("block_rows, pivots", [(4096, None), (60, 6)])
def test_pieces_make_the_clusters_of_brute_force(spark, kind, block_rows, pivots):
    rows, eps, least = shapes(kind)
    rows = rows[np.random.default_rng(1).permutation(len(rows))]
    got = unsupervised.dbscan(to_frame(spark, rows), eps, least, block_rows, pivots).orderBy("id").toPandas()
    assert got["label"].tolist() == brute(rows, eps, least).tolist()


def test_large_pieces_do_not_meet_themselves(spark, monkeypatch):
    """Blocks only look at undecided points: with one dense region none are left."""
    rows, eps, least = shapes("one")
    sizes = []
    plain = unsupervised.pair_blocks
    monkeypatch.setattr(unsupervised, "pair_blocks", lambda q, b, **k: sizes.append(q.count()) or plain(q, b, **k))
    unsupervised.dbscan(to_frame(spark, rows), eps, least, 60, 6).count()
    assert sum(sizes) < len(rows)  # all rows were counted and linked before, 1,000 in total


def test_many_links_are_joined_by_spark(spark, monkeypatch):
    rows, eps, least = shapes("blobs")
    monkeypatch.setattr(unsupervised, "DRIVER_EDGES", 3)
    got = unsupervised.dbscan(to_frame(spark, rows), eps, least, 60, 6).orderBy("id").toPandas()
    assert got["label"].tolist() == brute(rows, eps, least).tolist()


def test_no_points(spark):
    empty = to_frame(spark, np.zeros((1, 2))).limit(0)
    assert unsupervised.dbscan(empty, 1.0, 2).count() == 0
