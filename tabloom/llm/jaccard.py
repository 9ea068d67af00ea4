"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 3-word shingles as 64-bit hashes.  Equal sets are
one class from the start, so copies never meet each other.  Class representatives are put
into groups of similar sets (same pair of smallest hashes), and the token-group matrix keeps
for every group the union of its members' prefix tokens.  Two sets that reach the threshold ``t``
share ``SHARED`` tokens among the first ``n - ceil(t n) + SHARED`` of each in any fixed order of tokens
(or all, if they have fewer), so a group is opened to another one only if their rows of the matrix have
as many in common and their sizes can reach ``t``.  Within the opened group the bound is applied again to its whole
token union: a visitor of ``n`` tokens stays only if the union holds ``t n`` of them.  What
is left is compared exactly, and the links feed connected components.

The order of tokens puts frequent ones last, from counts over all documents: any token in
at least ``OFTEN`` documents of some batch is counted, and the ``FREQUENT`` most counted ones are
kept.  The order only decides the speed; every order gives the same links.

Large groups are split into blocks of about ``BLOCK_TOKENS`` tokens that visit each other,
and visitors are handed out in lots of the same size, so no task holds a whole hot group.
A block reports one link per set it can reach, never all pairs; no link
between different sets is lost to the components.

Defined cases: NULL and wordless texts have an empty set and are alone; fewer than three
words make one shingle of the whole sequence; repeated rows and rows with
one id are kept; a set that only rows without id have links with nothing (component NULL).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bloom import block_count, bloom_table, free_names, possible, without
from tabloom.llm.words import portions, spaced_words, stored, utf8
from tabloom.session import cut_lineage

SHINGLE = 3
PERCENT = 90
SHARED = 3  # prefix tokens that two sets over the threshold have in common at least
OFTEN = 3
FREQUENT = 1 << 18
BLOCK_TOKENS = 1 << 21
MEMO_WORDS = 100_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9], np.uint64)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self):
        self.memo = _Memo()

    def __call__(self, text: bytes) -> np.ndarray:
        found = spaced_words(text)
        if len(found) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)] if found else [], np.uint64)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))
        mixed = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[3]
        return np.unique(mixed ^ (mixed >> np.uint64(29)))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def least_partner_size(percent: int = PERCENT) -> int:
    """Smaller sets reach the threshold with equal sets only: one token more is too many."""
    return -(-percent // (100 - percent)) if percent < 100 else 1


def _frequent(documents: DataFrame, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their rank from the rarest; at most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            tokens = np.concatenate([shingles(b) for part in portions([batch]) for b in utf8(part.column(0))])
            tokens.sort()
            first = np.flatnonzero(np.concatenate([[len(tokens) > 0], tokens[1:] != tokens[:-1]]))
            n = np.diff(first, append=len(tokens))
            kept = n >= OFTEN
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[first[kept]].view(np.int64)), pa.array(n[kept])], names=["token", "n"]
            )

    counts = documents.select(text).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(most).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - np.arange(len(tokens)))[order]


def _signatures(documents: DataFrame, doc_id: str, text: str, percent: int, frequent) -> DataFrame:
    """(doc_id, text_key, n, key, home, prefix): size, content key, group key and prefix tokens of every set."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        often, ranks = shared.value
        for batch in portions(batches):
            sizes, keys, homes, prefixes = [], [], [], []
            for body in utf8(batch.column(1)):
                tokens = shingles(body)
                n = len(tokens)
                rank = np.zeros(n, np.int64)
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    rank = np.where(often[at] == tokens, ranks[at], 0)
                # Rare tokens come with edits of a copy, so a set that is mostly
                # frequent ones is grouped by those.
                steady = tokens[rank > 0] if 2 * np.count_nonzero(rank) >= n else tokens
                even = steady & np.uint64(1) == 0
                pair = [int(x.min()) if len(x) else 0 for x in (steady[even], steady[~even])]
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                homes.append(xxhash.xxh3_64_intdigest(np.array(pair, np.uint64).tobytes()) - (1 << 63))
                first = n - least_overlap(n, percent) + SHARED if n else 0
                prefixes.append(tokens[np.argsort(rank, kind="stable")[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(homes, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n", "key", "home", "prefix"],
            )

    rows = documents.select(F.col(doc_id).cast("bigint"), text, F.xxhash64(text))
    return rows.mapInArrow(sign, "doc_id bigint, text_key bigint, n bigint, key binary, home bigint, prefix array<bigint>")


def _matrix(signed: DataFrame, least: int) -> DataFrame:
    """The token-group matrix as (token, home, lo, hi): prefix tokens of all members, each once,
    with the sizes of the members that hold it.

    Repeats are merged inside each batch first, so copies and large groups shuffle a few rows.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            repeats = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            homes, sizes = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), repeats) for i in (0, 1))
            order = np.lexsort((homes, tokens))
            tokens, homes, sizes = tokens[order], homes[order], sizes[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (homes[1:] != homes[:-1])
            first = np.flatnonzero(new)
            lo, hi = (f.reduceat(sizes, first) if len(first) else sizes for f in (np.minimum, np.maximum))
            columns = [tokens[new], homes[new], lo, hi]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "home", "lo", "hi"])

    rows = signed.where(F.col("n") >= least).select("home", "n", "prefix")
    merged = rows.mapInArrow(distinct, "token bigint, home bigint, lo bigint, hi bigint").repartition("token")
    return merged.groupBy("token", "home").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _visits(signed: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """(home, visitor): groups that may hold linked sets, the smaller one visiting the larger."""
    least = least_partner_size(percent)
    matrix = _matrix(signed, least)
    left, right = (
        matrix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("home", "lo", "hi")]) for side in "ab"
    )
    fits = (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
    # Members too different in size never meet, not even for a moment.
    met = left.join(right, "token").where((F.col("home_a") < F.col("home_b")) & fits)
    shared = met.groupBy("home_a", "home_b").agg(F.count("*").alias("shared"))
    shared = shared.where(F.col("shared") >= min(SHARED, least_overlap(least, percent)))  # no pair needs fewer
    facts = ["home", "size", "lo", "hi"]
    for side in "ab":
        shared = shared.join(homes.select(*[F.col(c).alias(f"{c}_{side}") for c in facts]), f"home_{side}")
    enough = F.col("shared") >= F.least(F.lit(SHARED), "lo_a", "lo_b")
    larger = F.struct(F.col("size_a"), F.col("home_a")) > F.struct(F.col("size_b"), F.col("home_b"))
    return shared.where(fits & enough).select(
        F.when(larger, F.col("home_a")).otherwise(F.col("home_b")).alias("home"),
        F.when(larger, F.col("home_b")).otherwise(F.col("home_a")).alias("visitor"),
    )


def link_block(tokens: list[np.ndarray], members: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(root, reached) for every connected part of a block's sets.

    Visitors whose overlap with the members' token union can't reach the threshold are
    left out first.  A set is compared with all sets not yet reached at once.
    """
    sizes = np.array([len(t) for t in tokens])
    union = np.unique(np.concatenate([t for t, m in zip(tokens, members) if m] or [np.empty(0, np.uint64)]))
    kept = []
    for i, t in enumerate(tokens):
        if not members[i] and len(union):
            at = np.minimum(np.searchsorted(union, t), len(union) - 1)
            if np.count_nonzero(union[at] == t) * 100 < percent * len(t):
                continue
        kept.append(i)
    if len(kept) < 2:
        return []
    _, flat = np.unique(np.concatenate([tokens[i] for i in kept]), return_inverse=True)
    owner = np.repeat(np.arange(len(kept)), sizes[kept])
    bounds = np.concatenate([[0], np.cumsum(sizes[kept])])
    size = sizes[kept]
    mark = np.zeros(flat.max() + 1, bool)
    left = np.ones(len(kept), bool)
    rest, rest_owner, rest_count = flat, owner, len(kept)
    links = []
    for seed in range(len(kept)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            i = queue.pop()
            own = flat[bounds[i] : bounds[i + 1]]
            mark[own] = True
            overlap = np.bincount(rest_owner[mark[rest]], minlength=len(kept))
            mark[own] = False
            near = left & (100 * overlap >= percent * (size + size[i] - overlap))
            found = np.flatnonzero(near)
            left[found] = False
            queue += found.tolist()
            links += [(kept[seed], kept[j]) for j in found]
            count = int(left.sum())
            if count < 0.7 * rest_count:  # leave out what has been reached
                stay = left[rest_owner]
                rest, rest_owner, rest_count = rest[stay], rest_owner[stay], count
    return links


def _links(
    documents: DataFrame, sets: DataFrame, homes: DataFrame, visits: DataFrame, doc_id: str, text: str, percent: int
) -> DataFrame:
    """(a, b) content keys: one link for every set a block reaches."""
    blocks_of = homes.select("home", "blocks")
    coming = visits.join(sets.select(F.col("home").alias("visitor"), "key", "rep", "n"), "visitor").join(blocks_of, "home")
    coming = coming.select("home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "rep", "n")
    # Blocks of one group visit those before them.
    inner = sets.where("block > 0").select(
        "home", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), "key", "rep", "n"
    )
    guests = stored(coming.unionByName(inner), "visitors")
    lots = guests.groupBy("home", "block").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("lots"))
    guests = guests.join(lots, ["home", "block"]).select(
        "home", "block", F.pmod(F.xxhash64("key"), F.col("lots")).cast("int").alias("lot"), "key", "rep",
        F.lit(False).alias("member"),
    )
    hosts = sets.join(lots, ["home", "block"], "left").where((F.col("size") > 1) | F.col("lots").isNotNull()).select(
        "home", "block", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"), "key", "rep",
        F.lit(True).alias("member"),
    )
    work = stored(hosts.unionByName(guests), "work")
    needed = work.select("key", "rep").distinct()
    count = needed.count()
    blocks = block_count(count)
    bloom = bloom_table(needed, "rep", blocks)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in portions(batches):
            tokens = [shingles(b).tobytes() for b in utf8(batch.column(1))]
            keys = [xxhash.xxh3_128_digest(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())],
                names=["rep", "key", "tokens"],
            )

    texts = possible(documents.select(F.col(doc_id).cast("bigint").alias("rep"), text), "rep", bloom, blocks)
    tokens = texts.mapInArrow(shingle, "rep bigint, key binary, tokens binary")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("member", ascending=False).drop_duplicates("key")
        keys = group["key"].tolist()
        arrays = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
        found = link_block(arrays, group["member"].to_numpy(bool), percent)
        return pd.DataFrame({"a": [keys[i] for i, _ in found], "b": [keys[j] for _, j in found]}, columns=["a", "b"])

    return (
        work.join(tokens, ["key", "rep"]).select("home", "block", "lot", "member", "key", "tokens")
        .groupBy("home", "block", "lot").applyInPandas(link, "a binary, b binary")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the smallest node of its component.

    Alternating large-star and small-star rounds; joins only, so that a hub's
    neighbours are never gathered in one row.  The rounds grow with the logarithm of the size.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut_lineage(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        small = cut_lineage(small)
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def join_classes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; ``text_key`` hashes the text."""
    frequent = _frequent(documents, text, FREQUENT)
    signed = stored(_signatures(documents, doc_id, text, percent, frequent), "signatures")
    classes = stored(signed.groupBy("key", "n", "home").agg(F.min("doc_id").alias("rep")), "classes")
    known = classes.where((F.col("n") >= least_partner_size(percent)) & F.col("rep").isNotNull())
    homes = stored(
        known.groupBy("home").agg(
            F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"),
            F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"),
        ),
        "homes",
    )
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    sets = stored(known.join(homes.select("home", "size", "blocks"), "home").withColumn("block", block).drop("blocks"), "sets")
    visits = _visits(signed, homes, percent)
    roots = components(_links(documents, sets, homes, visits, doc_id, text, percent))
    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    labels = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_key = named.join(labels, "root").select("key", "component_id")
    joined = signed.select("doc_id", "text_key", "key", F.col("n").alias("n_shingles")).join(by_key, "key")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "text_key", "n_shingles", own.alias("component_id"))


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, less those linked to one with a smaller id.

    Of rows equal in id and text one stays; documents without words all stay.  Extra
    columns come back as they were, whatever their names.
    """
    judged = stored(join_classes(documents, doc_id, text, percent).where("n_shingles > 0"), "classes")
    row = F.struct("doc_id", "text_key").alias("row")
    named = judged.select(row, F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    counted = named.groupBy("row").agg(F.min("first").alias("first"), F.count("*").alias("copies"))
    dropped = stored(counted.where("NOT first OR copies > 1"), "dropped")
    key = F.struct(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    kept = without(documents, key, dropped, "row")
    again = dropped.where("first").select("row")
    if again.isEmpty():
        return kept
    blocks = block_count(again.count())
    own, copy = free_names(documents, "_key", "_copy")
    again = again.withColumnRenamed("row", copy)
    several = possible(documents.withColumn(own, key), own, bloom_table(again, copy, blocks), blocks)
    several = several.join(again, F.col(own).eqNullSafe(F.col(copy)), "left_semi").dropDuplicates([own])
    return kept.unionByName(several.drop(own))
