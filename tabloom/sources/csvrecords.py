"""CSV records from files that are split over tasks, line breaks inside quotes included.

A first scan of the lines tells for each split of a file how it ends if it begins at a record and if it
begins inside a quoted cell.  Chaining these (one row per split) gives how each split
really begins.  A second scan puts lines together to records; what crosses the end of a split is
joined by the split it began in.  A header fits its file's first split.  A quote only opens a cell at the cell's start, and is doubled inside it.

Quotes, commas and line feeds are single bytes in every encoding offered, so all of this
works on bytes; records are decoded when they are whole.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings tried in this order; the last one always decodes.
ENCODINGS = ["utf-8", "utf-8-sig", "big5", "cp950", "latin1"]
# The rest of a quoted cell, up to a quote that isn't doubled.
REST = re.compile(rb'(?:[^"]++|"")*+"')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, if it begins at a record or inside one."""
    at = 0
    while True:
        if inside:
            closed = REST.match(line, at)
            if closed is None:
                return True
            at, inside = line.find(b",", closed.end()) + 1, False
        elif line.startswith(b'"', at):
            at, inside = at + 1, True
            continue
        else:
            at = line.find(b",", at) + 1
        if at == 0:
            return False


@dataclass
class CsvFile:
    path: str
    encoding: str | None
    header: bytes
    # Splits that begin inside a cell, with the split its record began in.
    inside: dict[int, int] = field(default_factory=dict)
    unclosed: bool = False  # the last cell lacks its quote


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, file, at): lines as bytes, in order within a split."""
    source = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return source.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of lines of one split; a split may come in several runs, one after the other."""
    for batch in batches:
        if not len(batch):
            continue
        at, files = batch.column(2).to_numpy(), batch.column(1).to_pylist()
        lines, start = batch.column(0).to_pylist(), 0
        for end in range(1, len(batch) + 1):
            if end == len(batch) or files[end] != files[start] or at[end] != at[start]:
                yield (files[start], int(at[start])), lines[start:end]
                start = end


def file_facts(spark: SparkSession, path: str | Sequence[str], encodings: Sequence[str]) -> list[CsvFile]:
    """Encoding, header and open splits of every file, from one scan.

    One row per split reaches the driver, as in any listing of splits.
    """
    names = list(encodings)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for key, lines in _splits(batches):
            if held is None or held["key"] != key:
                if held is not None:
                    yield _fact(held)
                held = {"key": key, "ends": [False, True], "closes": False, "bad": [False] * len(names), "header": [], "open": key[1] == 0}
            whole = b"\n".join(lines)
            held["bad"] = [bad or not _decodes(whole, name) for bad, name in zip(held["bad"], names)]
            for line in lines if b'"' in whole or held["open"] else ():
                before = held["ends"]
                held["ends"] = [ends_inside(line, b) if b'"' in line else b for b in before]
                held["closes"] |= before[1] and not held["ends"][1]
                if held["open"]:
                    held["header"].append(line)
                    held["open"] = held["ends"][0]
        if held is not None:
            yield _fact(held)

    schema = "file string, at bigint, plain_end boolean, inside_end boolean, closes boolean, bad array<boolean>, header binary"
    rows = sorted(_lines(spark, path).mapInArrow(scan, schema).collect(), key=lambda r: (r.file, r.at))
    found: dict[str, CsvFile] = {}
    usable: dict[str, set[int]] = {}
    inside, home = False, 0
    for row in rows:
        if row.file not in found:
            found[row.file] = CsvFile(row.file, None, bytes(row.header or b""))
            usable[row.file], inside = set(range(len(names))), False
        usable[row.file] -= {i for i, bad in enumerate(row.bad) if bad}
        if inside:
            found[row.file].inside[row.at] = home
        if not inside or row.closes:
            home = row.at  # where a record that is still open at the end began
        inside = row.inside_end if inside else row.plain_end
        found[row.file].unclosed = inside
    for file, left in usable.items():
        found[file].encoding = names[min(left)] if left else None
    return list(found.values())


def _fact(held: dict) -> pa.RecordBatch:
    header = b"\n".join(held["header"]) if held["key"][1] == 0 else None
    row = {
        "file": held["key"][0], "at": held["key"][1], "plain_end": held["ends"][0], "inside_end": held["ends"][1],
        "closes": held["closes"], "bad": held["bad"], "header": header,
    }
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def _decodes(body: bytes, encoding: str) -> bool:
    try:
        body.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _text(body: bytes, encoding: str) -> str:
    return body.removesuffix(b"\r").decode(encoding)


def column_names(header: bytes, encoding: str) -> list[str]:
    """Names of the header record: empty ones by position, repeated ones with it."""
    text = _text(header, encoding).removeprefix("\ufeff")
    names = next(csv.reader([text]), []) if "\n" not in text else next(csv.reader(text.splitlines(keepends=True)), [])
    if not text.strip():
        return []
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def records(spark: SparkSession, files: Sequence[CsvFile], encoding: str) -> DataFrame:
    """(record): every record but the header of each file; blank lines between records are none."""
    # Few: only splits that begin inside a cell.
    homes = {(f.path, at): home for f in files for at, home in f.inside.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, inside, head = None, [], False, False
        whole: list[str] = []
        pieces: list[tuple] = []

        def put(last: bool) -> None:
            """A record that is whole, or the part of one that crosses an end of the split."""
            nonlocal head
            body = b"\n".join(parts)
            if held in homes and head:
                pieces.append((held[0], homes[held], held[1], body))
            elif last:
                pieces.append((held[0], held[1], held[1], body))
            elif body.strip():
                whole.append(_text(body, encoding))
            head = False
            parts.clear()

        for key, lines in _splits(batches):
            if key != held:
                if parts:
                    put(inside)
                # The first record of a file is its header.
                held, inside, head = key, key in homes, key in homes
                skip = key[1] == 0
            for line in lines:
                inside = ends_inside(line, inside) if b'"' in line else inside
                parts.append(line)
                if inside:
                    continue
                if skip:
                    skip = False
                    parts.clear()
                    continue
                put(False)
            if whole or pieces:
                yield _batch(whole, pieces)
                whole, pieces = [], []
        if parts:
            put(inside)
            yield _batch(whole, pieces)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        body = b"\n".join(rows.sort_values("at")["part"])
        return pd.DataFrame({"record": [_text(body, encoding)]})

    def made(some: Sequence[CsvFile]) -> DataFrame:
        return _lines(spark, [f.path for f in some]).mapInArrow(gather, "record string, file string, home bigint, at bigint, part binary")

    whole = made(files).where(F.col("record").isNotNull()).select("record")
    crossed = [f for f in files if f.inside or f.unclosed]
    if not crossed:
        return whole
    # Only files with such records are looked through again.
    parts = made(crossed).where(F.col("record").isNull())
    return whole.unionByName(parts.groupBy("file", "home").applyInPandas(join, "record string"))


def _batch(whole: list[str], pieces: list[tuple]) -> pa.RecordBatch:
    file, home, at, part = zip(*pieces) if pieces else ((),) * 4
    none = len(whole)
    columns = [
        pa.array([*whole, *[None] * len(pieces)], pa.string()), pa.array([*[None] * none, *file], pa.string()),
        pa.array([*[None] * none, *home], pa.int64()), pa.array([*[None] * none, *at], pa.int64()),
        pa.array([*[None] * none, *part], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["record", "file", "home", "at", "part"])
