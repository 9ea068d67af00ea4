"""Packed runs: values come back as they were, and few bytes travel for each of them."""

import datetime

import numpy as np
import pyarrow as pa
import pytest

from tabloom.operators import explain
from tabloom.plans import packed, permute


def test_batches_come_back():
    rng = np.random.default_rng(3)
    n = 3_000
    columns = {
        "few": pa.array([[1.5, None, float("nan"), -0.0, 0.0][i % 5] for i in range(n)]),
        "many": pa.array(rng.random(n)),
        "text": pa.array([[None, "", "ä", "abc"][i % 4] for i in range(n)]),
        "texts": pa.array([f"t{i}" if i % 3 else None for i in range(n)]),
        "flag": pa.array([[True, False, None][i % 3] for i in range(n)]),
        "day": pa.array([datetime.date(2024, 1, 1 + i % 9) for i in range(n)]),
        "list": pa.array([[i, None] if i % 2 else None for i in range(n)]),
        "none": pa.array([None] * n, pa.int64()),
    }
    batch = pa.record_batch(list(columns.values()), list(columns))
    for part in (batch, batch.slice(17, 900), batch.slice(2_990), batch.slice(5, 1), batch.slice(0, 0)):
        got = packed.unpack(*packed.pack(part), batch.schema)
        assert got.schema == part.schema and got.num_rows == part.num_rows
        assert all(repr(a.to_pylist()) == repr(b.to_pylist()) for a, b in zip(got.columns, part.columns))


def test_runs_and_groups():
    schema = pa.schema({"_pos": pa.int64(), "v": pa.string()})
    positions = [[5, 6, 7], [8], [1, 0], [20, 22, 23]]
    batches = [pa.record_batch([pa.array(p, pa.int64()), pa.array([f"v{x}" for x in p])], schema=schema) for p in positions]
    for most in (1, 3, 100):
        got = [(first, run.column(1).to_pylist()) for first, run in packed.runs(iter(batches), schema, most)]
        assert all(values == [f"v{first + i}" for i in range(len(values))] for first, values in got)
        assert sorted(v for _, values in got for v in values) == sorted(f"v{x}" for p in positions for x in p)
    assert [f for f, _ in packed.runs(iter(batches), schema, 100)] == [0, 5, 20, 22]
    keyed = [pa.record_batch([pa.array(k)], ["k"]) for k in ([1, 1, 2], [2, 2], [], [3], [4, 4])]
    keyed[2] = keyed[0].slice(0, 0)
    assert [(k, len(t)) for k, t in packed.grouped(iter(keyed), "k")] == [(1, 2), (2, 3), (3, 1), (4, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 101, 4097])
def test_a_permutation_runs_backwards(n):
    places = np.arange(n)
    for key in (-(2**63), -1, 0, 2**63 - 1):
        keys = np.full(n, key)
        assert np.array_equal(permute.restored(permute.permuted(places, keys, n), keys, n), places)
        assert np.array_equal(permute.permuted(places, keys[:1], n), permute.permuted(places, keys, n))


@pytest.mark.parametrize("size", [7, 1000])
def test_replicas_are_the_keyed_permutations(spark, monkeypatch, size):
    """Every value goes where the permutation sends it, whatever the chunks and runs."""
    monkeypatch.setattr(packed, "CHUNK_ROWS", (size, size))
    n = 333
    rows = [(i, f"k{i}", None if i % 5 == 0 else float(i), f"t{i % 4}") for i in range(n)]
    placed = spark.createDataFrame(rows, "_pos long, id string, a double, c string").repartition(6)
    keys = [[11, -12], [13, 14]]
    found = permute.replicas(placed, ["id", "a", "c"], ["c", "a"], keys).collect()
    assert len(found) == 4 * n
    got = {(x.f, x.r, x.id): (x.a, x.c) for x in found}
    for f in range(2):
        for r in range(2):
            to = permute.permuted(np.arange(n), np.array([keys[f][r]]), n)
            for i, place in enumerate(to):
                a, c = got[f, r, f"k{place}"]
                assert (c == rows[i][3] and a == rows[place][2]) if f == 0 else (a == rows[i][2] and c == rows[place][3])


def test_no_row_is_sent_for_a_value(spark):
    """The copies of a table meet its rows as few packed runs: no join, no row per value and copy."""
    rows = [(i, float(i % 50), f"t{i % 3}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, a double, c string")
    plan = explain.permuted_replicas(df, ["a", "c"], ["id"], 5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "payload" in plan
