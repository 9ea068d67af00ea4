"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

Documents are cut every ``capacity`` tokens; what is left over is one shorter piece.
Piece lengths are counted in classes of ``unit`` tokens, which leaves a histogram of at most
``capacity / unit`` numbers whatever the corpus size.  Over it the
Gilmore-Gomory linear program is solved by column generation: the simplex keeps one pattern
(how many pieces of each class fill a sequence) per class, and a knapsack by dynamic
programming prices every possible pattern at once, until none can improve.  Pattern
counts are rounded down, the few remaining pieces are filled first-fit, and the documents,
ranked within their class, are handed out to the patterns by rank.

Only the histogram and the patterns pass through the driver.  Ranks come from
two-level counts over (class, bucket), so a length that a third of all pieces share is ranked in
many tasks.  The tokens themselves are made once and leave their task only as lengths and
checksums unless ``with_ids`` is set.

Defined cases: NULL and empty texts hold the end token only; repeated documents are packed
each on its own; ties in rank go by id, start and checksum; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.words import portions, stored, utf8

CAPACITY = 4096
UNIT = 16
END_ID = 2
MEMO_WORDS = 200_000
LEAST_BUCKETS = 64
PIECES_PER_BUCKET = 100_000
# Lower-cased characters on which Python and the tokenizer agree: printable ASCII and the letters of Latin-1.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_KNOWN = re.compile(f"[!-~{_LETTERS}]+")
_GROUPS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
# The characters that the vocabulary writes bytes with.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_SPELT = "".join(chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Token ids of a white-space delimited chunk, asked of the tokenizer once; as
    little-endian unsigned 32-bit numbers, which join without a look at each.

    White space never enters a token of this vocabulary, so a text's ids are those of its
    chunks in turn.  Chunks of ASCII alone are lower-cased first, which its normaliser does
    anyway; others are not, as it composes before that and a composed capital differs.  A chunk of
    printable ASCII and Latin-1 letters has nothing to compose: it is cut into the tokenizer's
    groups here and only the groups' merges are asked of its model, which costs a third of a whole call.

    A full memo becomes the ``older`` one, from which words in use come back.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.merged(chunk) if chunk.isalpha() else self.asked(chunk)
        self[chunk] = ids
        return ids

    def asked(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        lower = text.lower()
        if not _KNOWN.fullmatch(lower):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        groups = _GROUPS.findall(lower)
        if len(groups) > 1:
            return b"".join([self[group.encode()] for group in groups])
        return self.merged(lower.encode())

    def merged(self, group: bytes) -> bytes:
        return packed([token.id for token in self.model.tokenize(charmap_decode(group, "strict", _SPELT)[0])])

    def shorten(self) -> None:
        if len(self) > MEMO_WORDS:
            self.older = dict(self)
            self.clear()


class Encoder:
    """ids of whole texts, equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.memo = _Memo(Tokenizer.from_file(path))

    def __call__(self, text: bytes, end_id: int) -> np.ndarray:
        self.memo.shorten()
        if b"<|" in text:  # may name a special token, in which white space or case matter
            ids = packed(self.memo.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        else:
            chunks = text.lower().split() if text.isascii() else [c.lower() if c.isascii() else c for c in text.split()]
            ids = b"".join(map(self.memo.__getitem__, chunks))
        return np.frombuffer(ids + packed([end_id]), "<u4")


def pieces(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents cut every ``capacity`` ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} bigint" for n in names) + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in portions(batches):
            rows, parts = [], []
            for key, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                ids = encode(body, end_id)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((key, start, len(part), zlib.crc32(part), len(ids)))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(names)
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return documents.select(F.col(doc_id).cast("bigint"), text).mapInArrow(cut, schema)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over classes 1 … capacity (class = size): value and counts."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        # Last class c taken, the rest filled at best: values[c] + value[room - c].
        options = values[:room] + value[room - 1 :: -1][:room]
        c = int(np.argmax(options))
        if options[c] > value[room - 1] + 1e-15:
            value[room], choice[room] = options[c], c + 1
        else:
            value[room] = value[room - 1]
    counts, room = np.zeros(capacity, np.int64), capacity
    while room > 0:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return value[capacity], counts


def column_generation(demand: np.ndarray, most_rounds: int = 3_000, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional use for classes of size 1 … len(demand).

    Revised simplex: the basis holds one pattern per class in demand.  Stops when no pattern can
    improve the bound by more than ``gap`` of the whole.
    """
    capacity = len(demand)
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    basis = np.zeros((capacity, m))
    basis[used, np.arange(m)] = capacity // (used + 1)
    inverse = np.diag(1.0 / (capacity // (used + 1)))
    amount = inverse @ demand[used]
    for _ in range(most_rounds):
        prices = np.ones(m) @ inverse
        values = np.zeros(capacity)
        values[used] = np.maximum(prices, 0)
        best, pattern = best_pattern(values, capacity)
        if best <= 1 + gap:
            break
        step = inverse @ pattern[used]
        ratio = np.where(step > 1e-12, amount / np.where(step > 1e-12, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        amount = np.maximum(inverse @ demand[used], 0)
    return basis.T.astype(np.int64), amount


def _first_fit(left: np.ndarray) -> list[np.ndarray]:
    """First-fit decreasing over class counts, copies of one filling at a time."""
    capacity, rows, left = len(left), [], left.copy()
    while left.any():
        room, pattern = capacity, np.zeros(capacity, np.int64)
        for c in range(capacity, 0, -1):
            take = min(int(left[c - 1]), room // c)
            pattern[c - 1] = take
            room -= take * c
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        rows.append((pattern, times))
        left -= pattern * times
    return rows


def integer_plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly the demand."""
    patterns, amount = column_generation(demand.astype(float))
    plan, left = [], demand.astype(np.int64).copy()
    for i in np.argsort(-amount):
        pattern = patterns[i]
        inside = pattern > 0
        times = min(int(np.floor(amount[i] + 1e-9)), int((left[inside] // pattern[inside]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    return plan + _first_fit(left)


def _plan_rows(plan: list[tuple[np.ndarray, int]]) -> list[tuple]:
    """(class, first rank, end rank, pieces a sequence, first sequence) of every pattern entry."""
    rows, at, sequence = [], {}, 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern).tolist():
            first = at.get(c, 0)
            at[c] = first + times * int(pattern[c])
            rows.append((c + 1, first, at[c], int(pattern[c]), sequence))
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in a sequence) to pieces."""
    spark = cut.sparkSession
    kind = F.ceil(F.col("length") / unit).cast("int")
    rows = cut.count()
    buckets = max(LEAST_BUCKETS, rows // PIECES_PER_BUCKET + 1)
    keyed = cut.withColumns(
        {"_class": kind, "_bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")}
    )
    counts = keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    # At most capacity / unit classes.
    demand = np.zeros(-(-capacity // unit), np.int64)
    for row in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect():
        demand[row._class - 1] = row.n
    entries = _plan_rows(integer_plan(demand))
    plan = spark.createDataFrame(entries, "_class int, _first long, _end long, _each int, _sequence long")
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = ["doc_id", "start", "ids_crc32"]
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(*order)) - 1)
        .join(offsets, ["_class", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # The plan has a few rows per class: bounded by capacity / unit.
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("_class", "_kind")),
        (F.col("_class") == F.col("_kind")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    ).withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order)
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(*cut.columns, "sequence_id", offset.alias("offset"))


def pack_documents(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset), one row per piece."""
    made = stored(pieces(documents, tokenizer, doc_id, text, capacity, end_id, with_ids), "pieces")
    return pack(made, capacity, unit)
