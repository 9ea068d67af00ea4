"""Exact BM25 top-k search with block-max WAND over sharded inverted indexes.

The texts are indexed in shards (runs of documents of one task), each one row of a Parquet table in
the shared folder: sorted terms, their postings (document, term frequency) and document lengths.
Document counts are summed over all shards, so scores use global statistics and the lists of the shards merge exactly.

Queries are searched in blocks of at most ``BLOCK_TERMS`` terms, broadcast one at a time; a larger query
set takes more passes, never more memory.  In a shard, terms are sorted by their largest possible
contribution: documents that hold only terms before the pivot can't reach the k-th best score so far
(WAND).  For the terms behind it, the largest contributions in each block of ``BLOCK_DOCS`` documents bound
the block, and only blocks that can reach that score are opened (block-max); their
documents are scored, bounded once more, and completed by the terms before the pivot.

Long queries leave little to prune, so in a shard they are taken in batches of ``BATCH`` and the lists are put in two
groups: the postings of seldom terms are summed one by one, frequent terms are rows of a matrix.  A block is bounded by its best sum
of seldom terms and the largest contributions of the frequent ones in it; for the blocks some query of the batch has to open, one
matrix product in single precision completes all documents.  Its error is bounded, and only documents that may be among the best
k within that bound are scored exactly, from their term frequencies.  Queries whose pivot leaves few postings go the way above.

Equal query texts are searched once.  Scores are rounded to six places; ties go to the smaller id.
The bounds keep a margin of one unit in the sixth place, so rounding can't lose a result.

Defined cases: NULL or wordless texts find nothing and are never found; documents without id are not
returned; repeated documents each take a place; fewer than ``k`` matches give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.words import PORTION_BYTES, portions, stored, utf8, words

K1, B = 1.2, 0.75
TOP = 10
SHARD_WORDS = 2_000_000
BLOCK_TERMS = 4_000_000
BLOCK_DOCS = 64
MEMO_WORDS = 100_000
RUN_POSTINGS = 1 << 16
MARGIN = 2e-6
BATCH = 128
DENSE_SHARE = 32  # a term in a 32nd of the documents or more is frequent
DENSE_CELLS = 8_000_000  # of a shard's matrix
FEW_POSTINGS = 16
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

INDEX_SCHEMA = "doc_ids array<bigint>, lengths array<int>, terms array<bigint>, counts array<int>, docs binary, tf binary"
_INDEX = pa.schema(
    {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "terms": pa.list_(pa.int64()),
     "counts": pa.list_(pa.int32()), "docs": pa.binary(), "tf": pa.binary()}
)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Terms:
    """Distinct term hashes of a text with their counts."""

    def __init__(self):
        self.memo = _Memo()

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        found = words(text)
        hashes = np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found)).view(np.int64)
        return *np.unique(hashes, return_counts=True), len(found)


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _Terms()
        ids, lengths, terms, tfs, size = [], [], [], [], 0

        def shard():
            # What is joined or sorted is let go at once: the postings are the worker's largest data.
            docs = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
            flat = np.concatenate(terms)
            terms.clear()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.concatenate([[len(flat) > 0], flat[1:] != flat[:-1]]))
            unique, n = flat[first], np.diff(first, append=len(flat)).astype(np.int32)
            del flat
            docs = docs[order].tobytes()
            tf = np.concatenate(tfs)
            tfs.clear()
            tf = tf[order].tobytes()
            del order
            row = {"doc_ids": [ids], "lengths": [lengths], "terms": [unique], "counts": [n], "docs": [docs], "tf": [tf]}
            return pa.RecordBatch.from_pydict(row, schema=_INDEX)

        for batch in portions(batches):
            for key, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found, n, length = split(body)
                ids.append(key)
                lengths.append(length)
                terms.append(found)
                tfs.append(n.astype(np.int32))
                size += length
                if size >= shard_words:
                    yield shard()
                    ids, lengths, terms, tfs, size = [], [], [], [], 0
        if ids:
            yield shard()

    kept = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).where("doc_id IS NOT NULL")
    return kept.mapInArrow(index, INDEX_SCHEMA)


def _query_terms(queries: DataFrame, text: str) -> DataFrame:
    """(query_key, term, qtf), one row per distinct term of each distinct text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in portions(batches):
            found = [terms(b) for b in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(t) for t, _, _ in found], pa.list_(pa.int64())),
                 pa.array([list(n) for _, n, _ in found], pa.list_(pa.int32()))],
                names=["query_key", "terms", "qtf"],
            )

    distinct = queries.select("query_key", text).dropDuplicates(["query_key"])
    rows = distinct.mapInArrow(split, "query_key bigint, terms array<bigint>, qtf array<int>")
    return rows.select("query_key", F.explode(F.arrays_zip("terms", "qtf")).alias("t")).select(
        "query_key", F.col("t.terms").alias("term"), F.col("t.qtf").alias("qtf")
    )


class QueryBlock(NamedTuple):
    keys: np.ndarray
    ends: np.ndarray  # of each query's terms
    vocabulary: np.ndarray  # distinct terms, sorted
    terms: np.ndarray  # places in it
    weights: np.ndarray  # query frequency times IDF
    average: float  # document length
    k: int


def _summed(
    places: np.ndarray, gains: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, size: int,
    allowed: np.ndarray | None = None,
) -> np.ndarray:
    """Weighted gains of several lists summed by place, about ``RUN_POSTINGS`` entries at a time.

    ``allowed`` tells for every block of places whether it counts.
    """
    sums = np.zeros(size)
    runs = np.cumsum(lengths) // RUN_POSTINGS
    cuts = np.flatnonzero(runs[1:] != runs[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(lengths)]):
        entries = _ranges(starts[a:b], lengths[a:b])
        at, gain = places[entries], np.repeat(weights[a:b], lengths[a:b]) * gains[entries]
        if allowed is not None:
            inside = allowed[at // BLOCK_DOCS]
            at, gain = at[inside], gain[inside]
        sums += np.bincount(at, gain, size)
    return sums


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Frequent(NamedTuple):
    """The lists of a shard's frequent terms as matrices."""

    row: np.ndarray  # of each term, -1: not frequent
    gains: np.ndarray  # term by document, single precision
    highest: np.ndarray  # term by block of documents
    tf: np.ndarray  # document by term


class Bounds(NamedTuple):
    """The largest contribution of every list in each block of documents it has."""

    block: np.ndarray
    highest: np.ndarray
    starts: np.ndarray  # of each list
    counts: np.ndarray


class Shard:
    """Postings of one shard with their largest contributions per list and per block."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms, counts, docs, tf, average: float):
        self.ids, self.terms = ids, terms
        self.docs, self.tf = docs, tf
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.norm = norm = K1 * (1 - B + B * lengths / average)
        self.gain = np.empty(len(docs))
        for i in range(0, len(docs), RUN_POSTINGS):
            run = slice(i, i + RUN_POSTINGS)
            self.gain[run] = tf[run] * (K1 + 1) / (tf[run] + norm[docs[run]])
        self.highest = np.maximum.reduceat(self.gain, self.starts) if len(terms) else self.gain
        self.blocks = len(ids) // BLOCK_DOCS + 1

    @cached_property
    def bounds(self) -> Bounds:
        block = self.docs // BLOCK_DOCS
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[self.starts] = True
        first = np.flatnonzero(new)
        starts = np.searchsorted(first, self.starts)
        highest = np.maximum.reduceat(self.gain, first) if len(first) else self.gain
        return Bounds(block[first], highest, starts, np.searchsorted(first, self.ends) - starts)

    @cached_property
    def frequent(self) -> Frequent:
        counts, size = self.ends - self.starts, self.blocks * BLOCK_DOCS
        places = np.flatnonzero(counts * DENSE_SHARE >= len(self.ids))
        if len(places) > DENSE_CELLS // size:
            places = places[np.argsort(-counts[places], kind="stable")[: DENSE_CELLS // size]]
        row = np.full(len(self.terms), -1, np.int32)
        row[places] = np.arange(len(places))
        gains = np.zeros((len(places), size), np.float32)
        most = max((int(self.tf[self.starts[p] : self.ends[p]].max()) for p in places), default=0)
        tf = np.zeros((len(self.ids), len(places)), np.min_scalar_type(most))
        for r, p in enumerate(places):
            mine = slice(self.starts[p], self.ends[p])
            gains[r, self.docs[mine]] = self.gain[mine]
            tf[self.docs[mine], r] = self.tf[mine]
        return Frequent(row, gains, gains.reshape(len(places), self.blocks, BLOCK_DOCS).max(axis=2), tf)

    def search_batch(
        self, at: list[np.ndarray], weight: list[np.ndarray], floor: np.ndarray, k: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, document numbers, scores) of several queries: all that may be among the ``k`` best and reach the floor."""
        dense = self.frequent
        size = self.blocks * BLOCK_DOCS
        batch, rows, rest = [], [], []
        for q, (places, w) in enumerate(zip(at, weight)):
            bound = w * self.highest[places]
            if not len(places) or bound.sum() < floor[q] - MARGIN:
                continue
            row = dense.row[places]
            seldom = places[row < 0]
            n = self.ends[seldom] - self.starts[seldom]
            if floor[q] > 0:
                order = np.argsort(bound, kind="stable")
                pivot = int(np.searchsorted(np.cumsum(bound[order]), floor[q] - MARGIN, "left"))
                lead = places[order[pivot:]]
                if (self.ends[lead] - self.starts[lead]).sum() * FEW_POSTINGS < n.sum():
                    yield q, *self.search(places, w, floor[q])
                    continue
            batch.append(q)
            rows.append(row)
            rest.append(_summed(self.docs, self.gain, self.starts[seldom], n, w[row < 0], size))
        if not batch:
            return
        factors = np.zeros((len(batch), len(dense.gains)), np.float32)
        for i, q in enumerate(batch):
            factors[i, rows[i][rows[i] >= 0]] = weight[q][rows[i] >= 0]
        sums = np.array(rest)
        del rest
        # Every number is rounded once or twice and summed: off by less than this share of the sum.
        slack = (len(dense.gains) + 8) * 2.0**-23
        least = floor[batch] - MARGIN
        highest = factors @ dense.highest * (1 + slack) + sums.reshape(len(batch), self.blocks, BLOCK_DOCS).max(axis=2)
        opened = np.flatnonzero((highest >= least[:, None]).any(axis=0))
        whole = len(opened) * 4 > self.blocks * 3
        gains = dense.gains if whole else dense.gains.reshape(-1, self.blocks, BLOCK_DOCS)[:, opened].reshape(len(dense.gains), -1)
        product = factors @ gains
        for i, q in enumerate(batch):
            own = sums[i] if whole else sums[i].reshape(self.blocks, BLOCK_DOCS)[opened].ravel()
            scores = product[i] + own
            found = np.flatnonzero((scores > 0) & (scores * (1 + slack) >= least[i]))
            if len(found) > k:
                near = scores[found]
                found = found[near * (1 + slack) >= np.partition(near, -k)[-k] * (1 - slack) - MARGIN]
            if not len(found):
                continue
            docs = found if whole else opened[found // BLOCK_DOCS] * BLOCK_DOCS + found % BLOCK_DOCS
            mine = rows[i] >= 0
            tf = dense.tf[docs[:, None], rows[i][mine]].astype(float)
            exact = sums[i][docs] + (tf * (K1 + 1) / (tf + self.norm[docs, None]) * weight[q][mine]).sum(axis=1)
            yield q, docs, exact

    def search(self, at: np.ndarray, weight: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of all that may reach ``floor``; ``at`` are places in ``terms``."""
        bound = weight * self.highest[at]
        order = np.argsort(bound, kind="stable")
        at, weight = at[order], weight[order]
        upto = np.cumsum(bound[order])
        pivot = int(np.searchsorted(upto, floor - MARGIN, "left"))  # before it: can't reach the floor alone
        rest = float(upto[pivot - 1]) if pivot else 0.0
        lead, lead_weight = at[pivot:], weight[pivot:]
        if not len(lead):
            return np.empty(0, np.int64), np.empty(0)
        open_blocks = None
        if floor > 0:
            by = self.bounds
            highest = _summed(by.block, by.highest, by.starts[lead], by.counts[lead], lead_weight, self.blocks)
            open_blocks = highest + rest >= floor - MARGIN
            if not open_blocks.any():
                return np.empty(0, np.int64), np.empty(0)
            if open_blocks.all():
                open_blocks = None
        n = self.ends[lead] - self.starts[lead]
        scores = _summed(self.docs, self.gain, self.starts[lead], n, lead_weight, len(self.ids), open_blocks)
        found = np.flatnonzero((scores > 0) & (scores + rest >= floor - MARGIN)).astype(np.int32)
        scores = scores[found]
        # The terms before the pivot, largest first, drop documents as the bound falls.
        for i in range(pivot - 1, -1, -1):
            if not len(found):
                break
            mine = slice(self.starts[at[i]], self.ends[at[i]])
            docs, gain = self.docs[mine], self.gain[mine]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            scores = scores + np.where(docs[place] == found, weight[i] * gain[place], 0.0)
            left = scores + (upto[i - 1] if i else 0.0) >= floor - MARGIN
            found, scores = found[left], scores[left]
        return found, scores


@contextmanager
def _shard_by_shard(spark: SparkSession) -> Iterator[None]:
    """Arrow batches end after a large row, as a task reads several shards."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(PORTION_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def _shard_of(batch: pa.RecordBatch, i: int, average: float) -> Shard:
    """The shard in row ``i``; its postings stay in the batch."""
    numbers = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
    binary = lambda name: np.frombuffer(batch.column(name)[i].as_buffer(), np.int32)
    return Shard(
        numbers("doc_ids"), numbers("lengths").astype(np.float64), numbers("terms"), numbers("counts").astype(np.int64),
        binary("docs"), binary("tf"), average,
    )


def _search_block(index: DataFrame, block: QueryBlock) -> DataFrame:
    """The best k of every query in each task's shards."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        starts = np.concatenate([[0], asked.ends[:-1]])
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(asked.keys)
        floor = np.zeros(len(asked.keys))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = None  # the last one goes before the next is built
                shard = _shard_of(batch, i, asked.average)
                if not len(shard.terms):
                    continue
                place = np.minimum(np.searchsorted(shard.terms, asked.vocabulary), len(shard.terms) - 1)
                place[shard.terms[place] != asked.vocabulary] = -1
                for first in range(0, len(asked.keys), BATCH):
                    at, weight = [], []
                    for a, b in zip(starts[first : first + BATCH], asked.ends[first : first + BATCH]):
                        places = place[asked.terms[a:b]]
                        at.append(places[places >= 0])
                        weight.append(asked.weights[a:b][places >= 0])
                    for q, found, scores in shard.search_batch(at, weight, floor[first : first + BATCH], asked.k):
                        if not len(found):
                            continue
                        q += first
                        ids, scores = shard.ids[found], np.round(scores, 6)
                        if best[q] is not None:
                            ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                        order = np.lexsort((ids, -scores))[: asked.k]
                        best[q] = ids[order], scores[order]
                        if len(order) == asked.k:
                            floor[q] = scores[order[-1]]
            shard = batch = None
        hits = [(q, *b) for q, b in enumerate(best) if b is not None]
        if hits:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked.keys[[q for q, _, _ in hits]], [len(i) for _, i, _ in hits])),
                 pa.array(np.concatenate([i for _, i, _ in hits])), pa.array(np.concatenate([s for _, _, s in hits]))],
                names=["query_key", "hit_id", "score"],
            )

    # Each task keeps one list of k hits a query for all its shards, so the hits don't grow with the shards.
    tasks = index.sparkSession.sparkContext.defaultParallelism
    return index.coalesce(tasks).mapInArrow(look, "query_key bigint, hit_id bigint, score double")


def top_k(
    documents: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
    query_id: str = "doc_id", query_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(query_id, rank, hit_id, score): the k best documents of every query by BM25."""
    spark = documents.sparkSession
    index = stored(build_index(documents, doc_id, text), "shards")
    sizes = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("w"))
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    number, average = whole.n or 0, max((whole.w or 0) / max(whole.n or 1, 1), 1.0)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("_text"))
    asked = asked.where("query_id IS NOT NULL AND _text IS NOT NULL").withColumn("query_key", F.xxhash64("_text"))
    terms = stored(_query_terms(asked, "_text"), "query-terms")
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(
        F.sum("t.counts").alias("df")
    )
    idf = F.log1p((F.lit(float(number)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(counts, "term").groupBy("query_key").agg(
        F.sort_array(F.collect_list(F.struct("term", (F.col("qtf") * idf).alias("weight")))).alias("terms")
    )
    blocks = terms.count() // block_terms + 1
    weighted = stored(weighted.withColumn("block", F.pmod(F.xxhash64("query_key"), F.lit(blocks))), "queries")
    found = None
    for number_ in range(blocks):
        # One bounded block of the stated query set at a time.
        rows = weighted.where(F.col("block") == number_).select("query_key", "terms.term", "terms.weight").toArrow()
        if not rows.num_rows:
            continue
        flat = lambda name, rows=rows: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(rows["term"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        vocabulary, places = np.unique(flat("term"), return_inverse=True)
        block = QueryBlock(rows["query_key"].to_numpy(), ends, vocabulary, places.astype(np.int32), flat("weight"), average, k)
        with _shard_by_shard(spark):
            hits = stored(_search_block(index, block), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_key bigint, hit_id bigint, score double")
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "hit_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return asked.select("query_id", "query_key").join(ranked, "query_key").select("query_id", "rank", "hit_id", "score")
