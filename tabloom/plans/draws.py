"""Rows drawn at random from a numbered table, several for each asking row, by packed runs.

Which positions a row draws follows from its hash alone.  Asking rows are put together to packs; a pack asks a
chunk of the numbered table for positions only, in ascending order, and gets back values only, in the same
order.  It finds out once more which of its rows drew them, so neither keys nor copies of rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.values import quoted
from tabloom.plans import packed
from tabloom.session import shared_folder

PACK_DRAWS = 1 << 21
CHUNK_DRAWS = 1 << 23  # positions asked of one copy of a chunk
MOST_ROWS = 1 << 16
OWN, GIVEN = 0, 1  # the order in which a task needs what it gets
_SENT = pa.schema(
    {"home": pa.int64(), "kind": pa.int32(), "pack": pa.int64(), "at": pa.int64(), "size": pa.int32(), "payload": pa.binary()}
)
SENT = "home bigint, kind int, pack bigint, at bigint, size int, payload binary"


def hashed_draws(hashes: np.ndarray, draws: int, rows: int) -> np.ndarray:
    """Spark's pmod(xxhash64(…, t), rows) for t = 0 … draws - 1, from xxhash64(…) without t."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + np.uint64(0x27D4EB2F165667C5 + 4)
        x = x ^ np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B185EBCA87)
        x = (x << np.uint64(23) | x >> np.uint64(41)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
        x = x ^ x >> np.uint64(32)
    return x.view(np.int64) % rows


def _steps(numbers: np.ndarray) -> tuple[int, bytes]:
    """Ascending numbers as compressed steps, byte by byte."""
    data = np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data), pa.Codec("zstd", packed.LEVEL).compress(data, asbytes=True)


def _numbers(size: int, payload: bytes) -> np.ndarray:
    data = np.frombuffer(pa.Codec("zstd").decompress(payload, size, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), _SENT.types)], schema=_SENT)


def with_draws(
    asking: DataFrame, hashed: Column, draws: int, numbered: DataFrame, names: dict[str, str], number: str = "t"
) -> DataFrame:
    """Every asking row once for each of its draws: its columns, the number of the draw, and of the drawn row ``names`` as called there.

    ``hashed`` is xxhash64 of what a row draws by, without the number; ``numbered`` has the positions 0 … n - 1 in ``_pos``.
    """
    spark = asking.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    # Packs are cut from this table, so a repeated task cuts the same ones.
    path = f"{shared_folder(spark)}/asking"
    asking.write.parquet(path)
    asking = spark.read.schema(asking.schema).parquet(path)
    rows, asked = numbered.count(), asking.count()
    size = packed.chunk_rows(rows, tasks)
    chunks = max(1, -(-rows // size))
    lanes = max(1, -(-asked * draws // (chunks * CHUNK_DRAWS)))
    pack_rows = max(1, min(PACK_DRAWS // draws, packed.chunk_rows(asked, tasks)))
    source = numbered.select("_pos", *[quoted(c).alias(alias) for c, alias in names.items()])
    own = asking.select(hashed.alias("_hash"), "*")
    source_schema, own_schema = packed.arrow_schema(source), packed.arrow_schema(own)
    values_schema = pa.schema([source_schema.field(i + 1) for i in range(len(names))])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, run in packed.runs(batches, source_schema):
            table, out = run.drop_columns(["_pos"]).combine_chunks().to_batches()[0], []
            for chunk in range(first // size, (first + len(run) - 1) // size + 1):
                a, b = max(chunk * size, first), min((chunk + 1) * size, first + len(run))
                part = packed.pack(table.slice(a - first, b - a))
                out += [(chunk * lanes + lane, OWN, -1, a, *part) for lane in range(lanes)]
            yield _rows(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, table in enumerate(packed.collected(batches, own_schema, pack_rows)):
            pack, batch = task + i, table.to_batches()[0]
            at = np.sort(hashed_draws(table.column(0).to_numpy(), draws, rows), axis=None)
            ends = np.searchsorted(at, np.arange(1, chunks + 1) * size)
            # The pack's own rows pass the chunks by on their way.
            out, start = [(-1 - pack, OWN, pack, -1, *packed.pack(batch))], 0
            for chunk, end in enumerate(ends):
                if end > start:
                    out.append((chunk * lanes + i % lanes, GIVEN, pack, chunk, *_steps(at[start:end] - chunk * size)))
                start = end
            yield _rows(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, group in packed.grouped(batches, "home"):
            if home < 0:
                yield from group.cast(_SENT).to_batches()
                continue
            parts = group.to_pydict()
            offered = [i for i, kind in enumerate(parts["kind"]) if kind == OWN]
            asks = [i for i, kind in enumerate(parts["kind"]) if kind == GIVEN]
            if not asks:
                continue
            opened = [packed.unpack(parts["size"][i], parts["payload"][i], values_schema) for i in offered]
            table = pa.Table.from_batches(opened, values_schema).combine_chunks().to_batches()[0]
            for some in (asks[i : i + 64] for i in range(0, len(asks), 64)):
                out = []
                for i in some:
                    found = table.take(pa.array(_numbers(parts["size"][i], parts["payload"][i])))
                    out.append((home, GIVEN, parts["pack"][i], parts["at"][i], *packed.pack(found)))
                yield _rows(out)

    result = T.StructType([*asking.schema.fields, T.StructField(number, T.IntegerType()), *source.schema.fields[1:]])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in packed.grouped(batches, "pack"):
            parts = list(zip(*(group.column(c).to_pylist() for c in ("kind", "at", "size", "payload"))))
            table = packed.unpack(*parts[0][2:], own_schema)
            given = [packed.unpack(*p[2:], values_schema) for p in parts[1:]]
            values = pa.Table.from_batches(given, values_schema).combine_chunks()
            at = hashed_draws(table.column(0).to_numpy(zero_copy_only=False), draws, rows).ravel()
            place = np.empty(len(at), np.int64)
            place[np.argsort(at, kind="stable")] = np.arange(len(at))
            step = max(1, MOST_ROWS // draws)
            for a in range(0, len(table), step):
                b = min(a + step, len(table))
                copies = table.take(pa.array(np.repeat(np.arange(a, b), draws)))
                numbers = pa.array(np.tile(np.arange(draws, dtype=np.int32), b - a))
                drawn = values.take(pa.array(place[a * draws : b * draws])).combine_chunks()
                yield from pa.table([*copies.columns[1:], numbers, *drawn.columns], result.names).to_batches()

    if not rows:
        return spark.createDataFrame([], result)
    sent = source.mapInArrow(offer, SENT).unionByName(own.mapInArrow(ask, SENT))
    answered = packed.meet(sent, "home", chunks * lanes, ["kind", "at"]).mapInArrow(answer, SENT)
    packs = max(1, -(-asked // pack_rows))
    return packed.meet(answered, "pack", packs, ["kind", "at"]).mapInArrow(receive, result)
