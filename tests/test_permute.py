"""Keyed permutations: bijections of every size, spread evenly, and the replicas made from them."""

import numpy as np
import pytest

from tabloom.operators import explain
from tabloom.plans.permute import permuted


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 99, 100, 101, 4097, 100_003])
def test_every_key_gives_a_bijection(n):
    places = np.arange(n)
    for key in (-(2**63), -1, 0, 12345, 2**63 - 1):
        assert np.array_equal(np.sort(permuted(places, np.full(n, key), n)), places)


def test_positions_are_sent_evenly():
    n, keys = 10, np.random.default_rng(4).integers(-(2**62), 2**62, 20_000)
    counts = np.zeros((n, n))
    for start in range(n):
        counts[start] = np.bincount(permuted(np.full(len(keys), start), keys, n), minlength=n)
    assert np.abs(counts / len(keys) - 1 / n).max() < 0.01
    one, other = permuted(np.arange(1000), np.full(1000, 1), 1000), permuted(np.arange(1000), np.full(1000, 2), 1000)
    assert (one == other).mean() < 0.02 and abs(np.corrcoef(np.arange(1000), one)[0, 1]) < 0.15


def test_replicas_shuffle_one_column_and_keep_the_others(spark):
    rows = [(f"k{i}", i if i % 7 else None, f"t{i % 5}", i * 2.5) for i in range(211)]
    df = spark.createDataFrame(rows, "id string, a bigint, `b c` string, d double").repartition(5)
    found = explain.permuted_replicas(df, ["a", "b c"], ["id"], 2, 7).collect()
    want = {r[0]: r[1:] for r in rows}
    shuffles = {}
    for f in range(2):
        for r in range(2):
            part = [x for x in found if (x.f, x.r) == (f, r)]
            assert sorted(x.id for x in part) == sorted(want)
            name, other, place = (("a", "b c", 0), ("b c", "a", 1))[f]
            assert all(x[other] == want[x.id][1 - place] and x.d == want[x.id][2] for x in part)
            assert sorted(str(x[name]) for x in part) == sorted(str(v[place]) for v in want.values())
            shuffles[f, r] = [x[name] for x in sorted(part, key=lambda x: x.id)]
            assert shuffles[f, r] != [want[i][place] for i in sorted(want)]
    assert shuffles[0, 0] != shuffles[0, 1]
    again = explain.permuted_replicas(df.repartition(3), ["a", "b c"], ["id"], 2, 7)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found))  # partitioning changes nothing
    assert explain.permuted_replicas(df.limit(0), ["a"], ["id"], 2, 7).count() == 0
    plan = explain.permuted_replicas(df, ["a"], ["id"], 2, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_sent_values_are_narrow_rows(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, f"t{i}") for i in range(50)], "id int, a double, b double, c string")
    found = explain.permuted_replicas(df, ["a", "c", "b"], ["id"], 2, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "_v2" not in plan  # no list per position; numbers share a column
    rows = found.collect()
    assert len(rows) == 300 and {(x.f, x.r) for x in rows} == {(f, r) for f in range(3) for r in range(2)}
    assert all(x.b == 2.0 * x.id for x in rows if x.f != 2) and sum(x.b for x in rows if x.f == 2) == 4900.0
