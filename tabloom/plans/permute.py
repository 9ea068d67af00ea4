"""Keyed permutations of the positions 0 … n - 1, computed by each row for itself.

A Feistel network over an a x b grid of positions, a and b next to the root of n, is a bijection for
every key.  Fewer than a of its places lie at n or above; who lands there goes on through the
network until it is below n again, which keeps the bijection.  No row needs another one, so
shuffling a column is one lookup by position.  The network also runs backwards, so a place knows
the position its value comes from, and ``replicas`` sends values without their places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.functions.values import quoted
from tabloom.plans import packed

ROUNDS = 8
MOST_ROWS = 1 << 16
_PARTS = pa.schema(
    {"chunk": pa.int32(), "f": pa.int32(), "first": pa.int64(), "length": pa.int32(), "size": pa.int32(), "payload": pa.binary()}
)


def _mixed(values: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
    """Well spread 64-bit numbers of value, key and round (multiply and shift)."""
    x = values.astype(np.uint64) ^ (keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _once(places: np.ndarray, keys: np.ndarray, a: int, b: int) -> np.ndarray:
    left, right = places // b, places % b
    for turn in range(ROUNDS):
        if turn % 2:
            right = (right + (_mixed(left, keys, turn) % np.uint64(b)).astype(np.int64)) % b
        else:
            left = (left + (_mixed(right, keys, turn) % np.uint64(a)).astype(np.int64)) % a
    return left * b + right


def _back(places: np.ndarray, keys: np.ndarray, a: int, b: int) -> np.ndarray:
    left, right = places // b, places % b
    for turn in reversed(range(ROUNDS)):
        if turn % 2:
            right = (right - (_mixed(left, keys, turn) % np.uint64(b)).astype(np.int64)) % b
        else:
            left = (left - (_mixed(right, keys, turn) % np.uint64(a)).astype(np.int64)) % a
    return left * b + right


def permuted(positions: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Where the permutation of each row's key sends its position; all positions are below ``n``."""
    return _walked(_once, positions, keys, n)


def restored(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The positions that ``permuted`` sends to the places."""
    return _walked(_back, places, keys, n)


def _walked(step, places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    a = isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)
    keys = keys.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        places = step(places.astype(np.int64), keys, a, b)
        while (out := np.flatnonzero(places >= n)).size:
            places[out] = step(places[out], keys[out] if keys.size > 1 else keys, a, b)
    return places


def replicas(placed: DataFrame, kept: Sequence[str], columns: Sequence[str], keys: Sequence[Sequence[int]]) -> DataFrame:
    """(f, r, ``kept``): all rows once per column number f and key number r, that column permuted by the key.

    ``placed`` has the positions 0 … n - 1 in ``_pos``.  A run of rows sends each chunk of positions its own rows, and the
    values of every column that some key sends there, packed in the order of their positions.
    """
    rows, repeats = placed.count(), max(map(len, keys), default=0)
    size = packed.chunk_rows(rows, placed.sparkSession.sparkContext.defaultParallelism)
    chunks = -(-rows // size)
    source = placed.select("_pos", *[quoted(c) for c in kept])
    schema = packed.arrow_schema(source)
    moved = [list(kept).index(c) for c in columns]
    own = pa.schema([schema.field(i + 1) for i in range(len(kept))])
    alone = [pa.schema([own.field(i)]) for i in moved]
    numbers = [[np.array([k], np.int64) for k in of] for of in keys]

    def row(chunk: int, f: int, first: int, length: int, part: pa.RecordBatch) -> tuple:
        return chunk, f, first, length, *packed.pack(part)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in packed.runs(batches, schema):
            n, out = len(run), []
            positions = np.arange(first, first + n)
            table = run.drop_columns([run.column_names[0]]).combine_chunks().to_batches()[0]
            for chunk in range(first // size, (first + n - 1) // size + 1):
                a, b = max(chunk * size, first), min((chunk + 1) * size, first + n)
                out.append(row(chunk, -1, a, b - a, table.slice(a - first, b - a)))
            yield _rows(out)
            for f, column in enumerate(moved):
                # By chunk, then by key, then by position.
                to = np.concatenate([permuted(positions, k, rows) // size * repeats + r for r, k in enumerate(numbers[f])])
                order = packed.order_by_small(to, chunks * repeats)
                ends = np.cumsum(np.bincount(to // repeats, minlength=chunks))
                values = pa.record_batch([table.column(column).take(pa.array(order % n))], schema=alone[f])
                out = []
                for chunk in np.flatnonzero(np.diff(ends, prepend=0)):
                    a, b = int(ends[chunk - 1]) if chunk else 0, int(ends[chunk])
                    out.append(row(int(chunk), f, first, n, values.slice(a, b - a)))
                yield _rows(out)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, group in packed.grouped(batches, "chunk"):
            parts = group.to_pydict()
            found: dict[int, list[int]] = {}
            for i, f in enumerate(parts["f"]):
                found.setdefault(f, []).append(i)
            opened = lambda f, kind: pa.Table.from_batches(
                [packed.unpack(parts["size"][i], parts["payload"][i], kind) for i in found[f]], kind  # noqa: B023
            ).combine_chunks()
            table = opened(-1, own)
            places = np.arange(chunk * size, min((chunk + 1) * size, rows))
            for f, column in enumerate(moved):
                values = opened(f, alone[f]).column(0)
                firsts = np.array([parts["first"][i] for i in found[f]])
                lasts = firsts + [parts["length"][i] for i in found[f]]
                orders, lengths = [], []
                for key in numbers[f]:
                    sources = restored(places, key, rows)
                    orders.append(np.argsort(sources))
                    sources = sources[orders[-1]]
                    lengths.append(np.searchsorted(sources, lasts) - np.searchsorted(sources, firsts))
                lengths = np.array(lengths)
                starts = (np.cumsum(lengths.T) - lengths.T.ravel()).reshape(lengths.T.shape).T
                for r, order in enumerate(orders):
                    at = np.empty(len(places), np.int64)
                    at[order] = packed.ranges(starts[r], lengths[r])
                    swapped = table.set_column(column, own.field(column), values.take(pa.array(at)))
                    marks = [pa.array(np.full(len(places), mark, np.int32)) for mark in (f, r)]
                    yield from pa.table([*marks, *swapped.columns], ["f", "r", *kept]).to_batches(MOST_ROWS)

    sent = source.mapInArrow(send, "chunk int, f int, first bigint, length int, size int, payload binary")
    fields = [T.StructField("f", T.IntegerType()), T.StructField("r", T.IntegerType()), *source.schema.fields[1:]]
    return packed.meet(sent, "chunk", chunks, ["f", "first"]).mapInArrow(receive, T.StructType(fields))


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), _PARTS.types)], schema=_PARTS)
