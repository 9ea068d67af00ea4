"""Blocked Bloom filter as a small table: 512-bit blocks, one bit in each of eight words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 32  # 16 bits a key


def block_count(keys: int, most: int = MAX_BLOCKS) -> int:
    """Blocks for a number of keys; beyond ``most`` only false positives grow."""
    return min(most, max(1, keys // KEYS_PER_BLOCK + 1))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit a key sets in one word of its block: six bits of a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 6 * word).bitwiseAND(63)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _w0 … _w7), at most ``blocks`` rows of nine numbers."""
    sums = [F.bit_or(_bit(F.col(key), i)).alias(f"_w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(F.col(key), blocks).alias("_block")).agg(*sums)


def _looked_up(df: DataFrame, key: str, bloom: DataFrame, blocks: int, how: str) -> tuple[DataFrame, Column]:
    """Rows next to the block of their key, and whether all its bits are set.

    The filter table is broadcast; its size is bounded by ``MAX_BLOCKS``.
    """
    block, *places = free_names(df, "_block", *(f"_w{i}" for i in range(WORDS)))
    passed = F.lit(True)
    for i, place in enumerate(places):
        passed = passed & (F.col(place).bitwiseAND(_bit(F.col(key), i)) != 0)
    looked = df.withColumn(block, _block(F.col(key), blocks))
    return looked.join(F.broadcast(bloom.toDF(block, *places)), block, how), passed


def possible(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and few others.

    All columns of ``df`` come back as they were, whatever their names.
    """
    looked, passed = _looked_up(df, key, bloom, blocks, "inner")
    return looked.where(passed).select(*df.columns)


def without(df: DataFrame, key: Column, dropped: DataFrame, dropped_key: str) -> DataFrame:
    """``df`` less the rows whose key stands in ``dropped``; NULL counts as a value.

    Rows that can't be in it pass by the filter without a shuffle; only the rest,
    the dropped rows and a few others, meets the exact anti join.  All columns of
    ``df`` come back as they were, whatever their names.
    """
    own, gone, maybe = free_names(df, "_key", "_dropped", "_maybe")
    keys = dropped.select(F.col(dropped_key).alias(gone)).distinct()
    blocks = block_count(keys.count())
    named = df.withColumn(own, key)
    looked, passed = _looked_up(named, own, bloom_table(keys, gone, blocks), blocks, "left")
    looked = looked.withColumn(maybe, F.coalesce(passed, F.lit(False)))
    kept = looked.where(F.col(maybe)).join(keys, F.col(own).eqNullSafe(F.col(gone)), "left_anti")
    return looked.where(~F.col(maybe)).select(*df.columns).unionByName(kept.select(*df.columns))
