"""Sharding by sampled splitters: near-equal bytes in every shard.

Every record has a 64-bit sort key whose upper bits hash the text and whose lower
bits hash the id, so equal texts lie together and yet can be cut.  A sample weighted by size (and evenly by
rows, so that tiny records count too) gives quantile boundaries for many fine
ranges; exact sizes are then counted per range, and overfull ranges are subdivided with a
fresh sample of their own.  Inside a range a window orders the records, and the running
sum of bytes places each one: a record, or a group of equal texts of at most ``TOLERANCE``
of a shard, goes where its middle falls.  Larger groups are cut.

The splitters are bounded by ``SAMPLE`` and are all that reaches the driver besides one row per range.

Law ``bytes``: shard sizes differ by at most ``TOLERANCE`` of a shard plus one record.

Defined cases: a NULL text has no bytes (size 1) and the checksum of nothing; records equal in
key and id are placed in any order among themselves; empty shards are possible
if there are fewer records than shards; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.words import stored

SHARDS = 8
SAMPLE = 1 << 20  # keys drawn at most, on average
PER_RANGE = 16  # keys drawn for each range
RECORDS_PER_RANGE = 50_000
LEAST_RANGES = 512
OVERFULL = 4.0
TOLERANCE = 0.02
GROUP_BITS = 40


def _records(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(text, F.lit(""))
    low = 64 - GROUP_BITS
    group = F.call_function("shiftleft", F.shiftright(F.xxhash64(body), low), F.lit(low))
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        group.bitwiseOR(F.xxhash64(F.lit(1), doc_id).bitwiseAND((1 << low) - 1)).alias("key"),
    )


def _draw(records: DataFrame, weight: Column, seed: int) -> np.ndarray:
    """Keys drawn with chance ``weight``, the same ones on every run."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = records.where(chance < weight).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64))


def _quantiles(keys: np.ndarray, pieces: int) -> np.ndarray:
    """Cuts at equal shares of the drawn keys; groups that aren't cut in two stay whole."""
    if not len(keys):
        return keys
    cuts = np.unique(keys[np.linspace(0, len(keys), pieces + 1)[1:-1].astype(int)])
    group = cuts >> (64 - GROUP_BITS)
    alone = np.bincount(np.unique(group, return_inverse=True)[1])[np.unique(group, return_inverse=True)[1]] == 1
    return np.unique(np.where(alone, group << (64 - GROUP_BITS), cuts))


def _range_of(cuts: np.ndarray, records: DataFrame) -> Column:
    shared = records.sparkSession.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, keys.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return place(F.col("key"))


def splitters(records: DataFrame, rows: int, size: int, seed: int = 11, rounds: int = 2) -> np.ndarray:
    """Cut points of near-equal ranges, by size and by rows."""
    ranges = max(LEAST_RANGES, rows // RECORDS_PER_RANGE + 1)
    drawn = float(min(SAMPLE, ranges * PER_RANGE))
    share = F.col("size") / (2.0 * size) + 1.0 / (2.0 * rows)
    cuts = _quantiles(_draw(records, share * drawn, seed), ranges)
    for turn in range(1, rounds + 1):
        sums = records.groupBy(_range_of(cuts, records).alias("range")).agg(F.sum(share).alias("share"))
        over = {r.range: r.share for r in sums.where(F.col("share") > OVERFULL / ranges).collect()}
        if not over:
            break
        # Only records of the overfull ranges are drawn again, more densely.
        inside = records.where(_range_of(cuts, records).isin(list(over)))
        keys = _draw(inside, share * drawn, seed + turn)
        place = np.searchsorted(cuts, keys, "right")
        extra = [_quantiles(keys[place == r], int(np.ceil(s * ranges))) for r, s in over.items()]
        cuts = np.unique(np.concatenate([cuts, *extra]))
    return cuts


def shard_by_size(
    documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots count from 0 in each shard without gaps."""
    records = stored(_records(documents, doc_id, text), "records")
    whole = records.agg(F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    if not whole.rows:
        return records.select(
            "doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    cuts = splitters(records, whole.rows, whole.size)
    ranged = records.withColumn("range", _range_of(cuts, records))
    sums = sorted((r.range, r.size) for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect())
    before = np.concatenate([[0], np.cumsum([s for _, s in sums])])
    starts = _small(records, [(r, int(b)) for (r, _), b in zip(sums, before)], "range int, start long")
    order = ["_group", "key", "doc_id"]
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "_group")
    target = whole.size / shards
    end = F.col("_upto") + F.col("start")
    first = F.min(F.col("_upto") - F.col("size")).over(group) + F.col("start")
    middle = F.when(F.col("_bytes") <= tolerance * target, F.col("_first") + F.col("_bytes") / 2).otherwise(
        F.col("_end") - F.col("size") / 2
    )
    placed = (
        ranged.join(F.broadcast(starts), "range")
        .withColumn("_group", F.shiftright("key", 64 - GROUP_BITS))
        .withColumn("_upto", F.sum("size").over(upto))
        .withColumns({"_end": end, "_first": first, "_bytes": F.sum("size").over(group)})
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / target)).cast("int"))
    )
    inside = Window.partitionBy("range", "shard").orderBy(*order)
    placed = stored(
        placed.withColumn("_row", F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", "range", "shard", "_row"),
        "placed",
    )
    counts = sorted((r.shard, r.range, r.n) for r in placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    slots, last, total = [], None, 0
    for shard, piece, n in counts:
        total = total if shard == last else 0
        slots.append((shard, piece, total))
        last, total = shard, total + n
    offsets = _small(records, slots, "shard int, range int, _offset long")
    return placed.join(F.broadcast(offsets), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") + F.col("_offset")).alias("slot")
    )


def _small(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """One row per range (and shard at its ends): bounded by the number of splitters."""
    return df.sparkSession.createDataFrame(rows, schema)
