"""Small text and table helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import shared_folder

# A word is a run of digits, letters a-z (after lower-casing A-Z) and anything
# outside ASCII; every other ASCII character separates.
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Python works on this much of an Arrow batch at a time.
PORTION_BYTES = 1 << 22
_WORD_BYTES = bytes(LOWER[c] if LOWER[c] in _KEPT else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between the six ASCII white-space characters."""
    return text.translate(LOWER).split()


def portions(batches: Iterable, most: int = PORTION_BYTES) -> Iterator:
    """The batches or columns in slices of about ``most`` bytes.

    Spark's batches hold up to 10,000 whole texts; slices keep copies of them, and what is derived, small.
    """
    for batch in batches:
        rows = max(1, len(batch) * most // max(batch.nbytes, 1))
        for start in range(0, max(len(batch), 1), rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, NULL as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if value is None else value for value in column.cast(kind).to_pylist()]


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage with a table every executor can reach, so a lost executor costs
    only its running tasks; unlike a checkpoint it keeps column pruning.
    """
    spark = df.sparkSession
    name = re.sub(r"[^a-z0-9]+", "-", label.lower())
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
