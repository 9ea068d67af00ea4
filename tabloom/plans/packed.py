"""Values that travel between tasks as packed runs instead of rows.

Rows that are numbered without gaps are dealt into chunks of positions.  When a task knows for every value
which chunk needs it, and the chunk can compute for each of its places which position the value comes from, the
values of one run of positions go to one chunk as a single compressed batch in the order of their positions:
neither keys nor places are sent, and what is shuffled is about as large as the compressed column.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

RUN_ROWS = 1 << 18
CHUNK_ROWS = (1 << 10, 1 << 18)
MOST_PARTS = 2_000
LEVEL = 1


def chunk_rows(rows: int, tasks: int) -> int:
    """Positions of a chunk: a few chunks for every task, of bounded size."""
    least, most = CHUNK_ROWS
    return max(least, min(most, -(-rows // (4 * max(1, tasks)))))


def arrow_schema(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def _coded(values: pa.Array) -> pa.DictionaryArray | None:
    """The values as bytes that number few different ones, where they are few."""
    kind = values.type
    if not (pa.types.is_primitive(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)):
        return None
    some = values.slice(0, 256)
    if len(some.unique()) * 2 > len(some):
        return None
    coded = values.dictionary_encode(null_encoding="encode")
    return coded if len(coded.dictionary) <= 256 and len(coded.dictionary) * 4 <= len(values) else None


def pack(batch: pa.RecordBatch) -> tuple[int, bytes]:
    """(bytes, compressed batch without its schema)."""
    parts = []
    for i, values in enumerate(batch.columns):
        coded = _coded(values)
        whole = pa.record_batch([values if coded is None else coded.dictionary], [str(i)]).serialize().to_pybytes()
        parts.append((whole, b"" if coded is None else np.asarray(coded.indices).astype(np.uint8).tobytes()))
    data = pickle.dumps((batch.num_rows, parts), protocol=5)
    return len(data), pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def unpack(size: int, payload: bytes, schema: pa.Schema) -> pa.RecordBatch:
    rows, parts = pickle.loads(pa.Codec("zstd").decompress(payload, size, asbytes=True))
    columns = []
    for field, (whole, codes) in zip(schema, parts, strict=True):
        values = pa.ipc.read_record_batch(pa.py_buffer(whole), pa.schema([field])).column(0)
        columns.append(values.take(pa.array(np.frombuffer(codes, np.uint8))) if codes else values)
    return pa.record_batch(columns, schema=schema) if columns else pa.record_batch([pa.nulls(rows)], ["_"]).select([])


def collected(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).cast(schema).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).cast(schema).combine_chunks()


def runs(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int = RUN_ROWS) -> Iterator[tuple[int, pa.Table]]:
    """(first position, rows in order) of runs without gaps; the first column is the position."""
    for table in collected(batches, schema, most):
        positions = table.column(0).to_numpy()
        if (positions[1:] < positions[:-1]).any():
            order = np.argsort(positions, kind="stable")
            table, positions = table.take(order), positions[order]
        cuts = np.flatnonzero(positions[1:] != positions[:-1] + 1) + 1
        for a, b in zip([0, *cuts], [*cuts, len(positions)]):
            yield int(positions[a]), table.slice(a, b - a)


def grouped(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, its rows) of batches sorted by an integer key."""
    held, key = [], None
    for batch in batches:
        keys = batch.column(name).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if held and keys[a] != key:
                yield int(key), pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(key), pa.Table.from_batches(held)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def order_by_small(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; few of them are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def meet(sent: DataFrame, key: str, keys: int, order: list[str]) -> DataFrame:
    """Packed runs of a key behind each other in one task."""
    return sent.repartition(max(1, min(keys, MOST_PARTS)), key).sortWithinPartitions(key, *order)
