"""Inverted lists against the exact join and plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbour_index as index
from tabloom.operators import neighbours

FOLDER = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id bigint, vec array<double>")


@pytest.fixture(scope="module")
def points(spark):
    return neighbours.points(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), "vec_id", "embedding").cache()


def plain(points, k):
    """Brute force in plain NumPy: the k nearest others of every twentieth vector."""
    rows = points.collect()
    ids, vectors = np.array([r.id for r in rows]), np.array([r.vec for r in rows])
    found = {}
    for i in np.flatnonzero(ids % 20 == 0):
        gaps = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        gaps[i] = np.inf
        found[int(ids[i])] = np.sort(gaps)[:k]
    return found


def test_recall_against_brute_force(spark, points):
    asked = points.where("id % 20 = 0")
    rows = index.knn_indexed(asked, points, 5, exclude_self=True).collect()
    want = plain(points, 5)
    hits = sum(r.distance <= want[r.query_id][-1] + 1e-5 for r in rows)  # as near as the fifth exact one
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(r.query_id != r.neighbour_id for r in rows)
    assert len({(r.query_id, r.neighbour_id) for r in rows}) == len(rows)


def test_needed_lists_follow_the_wanted_recall(spark, points):
    built = index.build_index(points, 5, tables=3)
    assert built.lists.count() == 3 * points.count()  # every row once per table
    asked = points.where("id % 20 = 0")
    counts = [index.lists_to_open(built, asked, 5, True, recall) for recall in (0.3, 0.8, 1.0)]
    assert counts == sorted(counts) and counts[0] < counts[-1] <= index.LEAST_LISTS
    exact = neighbours.knn_join(asked, points, 5, exclude_self=True)
    few = index.measured_recall(index.search(built, asked, 5, True, probes=1), exact)
    all_lists = index.search(built, asked, 5, True, probes=index.LEAST_LISTS, block_rows=7)
    assert few < 0.9
    assert sorted(map(tuple, all_lists.collect())) == sorted(map(tuple, exact.collect()))


def test_copies_ties_and_small_tables(spark):
    """A third of all rows are one vector; ids decide among equals, as in the exact join."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0]) if i % 3 == 0 else (i, rng.integers(0, 4, 2)) for i in range(400)]
    df = frame(spark, rows)
    for own in (True, False):
        got = index.search(index.build_index(df, 4), df, 4, own, recall=1.0)
        want = neighbours.knn_join(df, df, 4, own)
        assert index.measured_recall(got, want) == 1.0
    one = frame(spark, [(7, [0.0, 1.0])])
    assert [tuple(r) for r in index.knn_indexed(one, one, 3).collect()] == [(7, 7, 1, 0.0)]
    assert index.knn_indexed(one, one, 3, exclude_self=True).count() == 0
    empty = one.limit(0)
    assert index.knn_indexed(empty, one, 3).count() == 0
    assert index.knn_indexed(one, empty, 3).count() == 0
    with pytest.raises(ValueError):
        index.search(index.build_index(one, 2), one, 3)


def test_classifier_takes_the_index(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(8 * (i % 3), 1, 4)) for i in range(300)]
    train = frame(spark, rows).withColumn("label", F.concat(F.lit("c"), F.col("id") % 3))
    got = neighbours.knn_classify(train, train, 5, join=index.knn_indexed)
    assert got.count() == 300
    assert got.where("predicted <> concat('c', query_id % 3)").count() == 0
