"""Exact duplicates over batches, against immutable snapshots of what came before.

Every batch becomes a snapshot that never changes: its distinct texts lie in exact buckets (a
table bucketed by a 64-bit digest), and over the digests of every range stands one static binary fuse filter.
A new batch is first grouped by itself: equal texts of the batch become one group.  The groups' digests are
then screened by the filters of each earlier snapshot, and only those that pass meet its exact buckets, where texts are
compared byte by byte.  A group joins the first snapshot that holds its text; a digest that two texts share joins nothing.

Texts are equal if they are identical without the characters ``[\\x20\\x09-\\x0D]``; groups of a batch are told
apart by the SHA-256 of what remains.  Copies are counted in each task before anything is shuffled, so a text that a third of
all rows share is one row a task; its rows later get their result by a broadcast of at most ``HEAVY`` groups.  Texts are shuffled
once, for their snapshot; filters cover ``KEYS_PER_FILTER`` digests on average and come to their keys by a keyed cogroup whose
slices are bounded.

Defined cases: NULL is the empty text, and so is white space alone; of equal texts the row with most code points stays, then
the smallest id (NULL last), then any one of the repeated rows; an empty table gives no rows; very long texts are taken whole;
extra columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import fuse
from tabloom.llm.words import stored
from tabloom.plans.skew import join_weighted
from tabloom.session import shared_folder

KEYS_PER_FILTER = 8192
LEAST_FILTERS = 64
SLICE = 1 << 18  # digests screened by one task at a time, on average
BATCHES = 3


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_of(sha: Column, bits: int = 64) -> Column:
    return F.shiftrightunsigned(F.xxhash64(sha), 64 - bits)


@dataclass(frozen=True)
class Snapshot:
    """``exact``: (digest, texts of (sha, content)), bucketed by digest; ``filters``: one row per range of digests."""

    exact: DataFrame
    filters: DataFrame
    ranges: int


def _texts(batch: DataFrame, text: str, bits: int) -> DataFrame:
    """(digest, texts): the distinct texts of a batch, copies dropped in each task first."""
    body = batch.select(content(F.col(text)).alias("content")).withColumn("sha", F.sha2("content", 256))
    keyed = body.select(digest_of(F.col("sha"), bits).alias("digest"), F.struct("sha", "content").alias("one"))
    return keyed.groupBy("digest").agg(F.collect_set("one").alias("texts"))


def _bucketed(df: DataFrame) -> DataFrame:
    """Written bucketed by digest as the shuffle has it, so that later joins leave it in place."""
    spark = df.sparkSession
    name = f"exact_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "digest").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _range(ranges: int) -> Column:
    return F.pmod("digest", F.lit(ranges)).cast("int").alias("range")


def build_filters(digests: DataFrame, ranges: int) -> DataFrame:
    """(range, seed, bits, segments, cells): a fuse filter for each range of digests."""

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(rows["digest"].to_numpy())
        return pd.DataFrame([(key[0], f.seed, f.bits, f.segments, f.cells.tobytes())], columns=["range", "seed", "bits", "segments", "cells"])

    ranged = digests.select("digest", _range(ranges))
    return ranged.groupBy("range").applyInPandas(make, "range int, seed int, bits int, segments int, cells binary")


def take_snapshot(batch: DataFrame, distinct: int, text: str = "text", bits: int = 64) -> Snapshot:
    """The snapshot of a batch of about ``distinct`` different texts."""
    exact = _bucketed(_texts(batch, text, bits))
    ranges = max(LEAST_FILTERS, distinct // KEYS_PER_FILTER + 1)
    return Snapshot(exact, stored(build_filters(exact, ranges), "filters"), ranges)


def screen(digests: DataFrame, snapshot: Snapshot, incoming: int) -> DataFrame:
    """(digest) that may be in the snapshot; ``digests`` are distinct, about ``incoming`` of them."""
    slices = incoming // (snapshot.ranges * SLICE) + 1

    def look(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(rows):
            return rows[["digest"]].iloc[:0]
        row = held.iloc[0]
        one = fuse.Fuse(int(row["seed"]), int(row["bits"]), int(row["segments"]), np.frombuffer(row["cells"], np.uint8))
        return rows.loc[one.passes(rows["digest"].to_numpy()), ["digest"]]

    part = F.pmod(F.xxhash64(F.lit(7), "digest"), F.lit(slices)).cast("int").alias("slice")
    rows = digests.select("digest", _range(snapshot.ranges), part).groupBy("range", "slice")
    held = snapshot.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows.cogroup(held.groupBy("range", "slice")).applyInPandas(look, "digest bigint")


def confirm(possible: DataFrame, new: Snapshot, old: Snapshot) -> DataFrame:
    """(sha) of the new snapshot's texts that the old one holds, byte by byte."""
    ours = new.exact.join(possible, "digest").select("digest", F.explode("texts").alias("ours"))
    theirs = old.exact.select("digest", F.col("texts").alias("theirs"))
    same = F.exists("theirs", lambda t: t["content"] == F.col("ours.content"))
    return ours.join(theirs, "digest").where(same).select(F.col("ours.sha").alias("sha"))


def deduplicate(
    documents: DataFrame, batch: Column, batches: int, doc_id: str = "doc_id", text: str = "text", bits: int = 64
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; ``batch`` numbers the batches from 0 as they came.

    ``bits`` is the width of the digest that filters and buckets are keyed by.
    """
    rows = stored(
        documents.select(
            F.col(doc_id).alias("doc_id"), batch.cast("int").alias("batch"), F.sha2(content(F.col(text)), 256).alias("sha"),
            F.length(F.coalesce(text, F.lit(""))).alias("points"), F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = stored(rows.groupBy("batch", "sha").agg(F.count("*").alias("n"), best.alias("best")), "groups")
    sizes = {r.batch: r.n for r in groups.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    snapshots: list[Snapshot] = []
    links: list[DataFrame] = []
    for number in range(batches):
        own = groups.where(F.col("batch") == number).select(digest_of(F.col("sha"), bits).alias("digest"))
        taken = take_snapshot(documents.where(batch == number), sizes.get(number, 0), text, bits)
        for earlier, held in enumerate(snapshots):
            possible = stored(screen(own.distinct() if bits < 64 else own, held, sizes.get(number, 0)), "possible")
            links.append(confirm(possible.distinct(), taken, held).select(F.lit(number).alias("batch"), "sha", F.lit(earlier).alias("root")))
        snapshots.append(taken)
    return resolve(rows, groups, links)


def resolve(rows: DataFrame, groups: DataFrame, links: Sequence[DataFrame]) -> DataFrame:
    """Every row's class: groups of one text in several batches join the first snapshot that holds it."""
    if links:
        first = reduce(DataFrame.unionByName, links).groupBy("batch", "sha").agg(F.min("root").alias("root"))
        groups = groups.join(first, ["batch", "sha"], "left")
    else:
        groups = groups.withColumn("root", F.lit(None).cast("int"))
    groups = groups.withColumn("root", F.coalesce("root", "batch"))
    classes = groups.groupBy("root", "sha").agg(F.sum("n").alias("group_size"), F.min("best").alias("keep"))
    found = stored(groups.join(classes, ["root", "sha"]).select("batch", "sha", "n", "group_size", "keep"), "classes")
    return join_weighted(rows, found, ["batch", "sha"], "n").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def by_arrival(doc_id: str = "doc_id", batches: int = BATCHES) -> Column:
    """Batches of near-equal size by a hash of the id, for a table that names none."""
    return F.pmod(F.xxhash64(F.lit(13), doc_id), F.lit(batches)).cast("int")
