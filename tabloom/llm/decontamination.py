"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed once: each segment (a bounded run of documents of
one task) is one row of a Parquet table in the shared folder, holding for every test term
its sorted positions in the segment.  Searching a segment starts from the rarest
term of each test window (document counts over the whole corpus, read off the
index), shifts that term's positions by its place in the window, and keeps the starts
that the offset-adjusted lists of the window's other terms also contain, rarest
first.  What survives all terms is an exact phrase match.  Starts at which at least
``NEAR_SHARE`` of the terms stand within ``slop`` words of their place are proximity
matches: of any ``missing + 1`` terms one must be there, so the starts are sought around the postings
of as many rarest terms.  Such starts of one window, up to ``slop`` apart, are one match, told by its
item and the place of its best start in the document; those with an exact match are left out.  Documents
lie further apart in a segment than any window reaches.  Segments are independent, so no postings are shuffled, a hot passage costs only
the rows that hold it, and a lost executor repeats only its own segments.

A window is ``width`` consecutive item words; a shorter item that has words is one window.

The test set is broadcast in passes of at most ``PASS_WORDS`` words; a larger one is
searched in several passes whose hits are merged per document, so nothing is cut.

Defined cases: NULL or wordless texts have no words, no hits and are clean; items
without words have no windows; repeated items hit alike, each item id counts once;
an item without id hits words but is not listed (among ``near`` as NULL); repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bloom import without
from tabloom.llm.words import portions, stored, utf8, words

WIDTH = 13
SLOP = 3
NEAR_SHARE = 0.8
PASS_WORDS = 2_000_000
SEGMENT_WORDS = 1 << 18

INDEX_SCHEMA = (
    "doc_ids array<bigint>, text_keys array<bigint>, n_words array<int>, terms array<int>, doc_counts array<int>, "
    "posting_ends array<int>, positions binary"
)
HITS_SCHEMA = (
    "doc_id bigint, text_key bigint, n_words bigint, spans array<int>, items array<string>, "
    "near array<struct<item:string,start:int>>, n_near bigint"
)
PAIRS = 1 << 19  # candidates looked at at once


class Windows(NamedTuple):
    """All windows of one pass of test items, as term numbers."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray  # (windows, width), -1 past the end of a short one
    size: np.ndarray  # words of each window
    item: np.ndarray  # place of its item id in ``ids``
    ids: list[str | None]


def windows_of(items: list[tuple[str | None, bytes]], width: int = WIDTH) -> Windows:
    vocabulary: dict[bytes, int] = {}
    rows, sizes, owners, ids = [], [], [], []
    for item_id, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        if not numbers:
            continue
        ids.append(item_id)
        for start in range(max(1, len(numbers) - width + 1)):
            part = numbers[start : start + width]
            rows.append(part + [-1] * (width - len(part)))
            sizes.append(len(part))
            owners.append(len(ids) - 1)
    terms = np.array(rows, np.int32).reshape(-1, width)
    return Windows(vocabulary, terms, np.array(sizes, np.int32), np.array(owners, np.int32), ids)


def reach(width: int, slop: int) -> int:
    """Free positions before each document: more than a window or a neighbour's slop can span."""
    return width + 2 * slop


def _starts(counts: np.ndarray, gap: int) -> np.ndarray:
    return gap + np.concatenate([[0], np.cumsum(counts + gap)[:-1]]).astype(np.int64)


def _segment(ids: list, keys: list, counts: list[int], numbers: list[np.ndarray], gap: int) -> dict:
    """Postings of one run of documents; positions count on through the segment.

    Documents are ``gap`` apart, so that no match can run from one into the next.
    """
    starts = _starts(np.array(counts, np.int64), gap)
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    place = np.concatenate([np.arange(len(n)) + s for n, s in zip(numbers, starts)]).astype(np.int32)
    document = np.repeat(np.arange(len(counts)), counts)
    known = flat >= 0
    flat, place, document = flat[known], place[known], document[known]
    order = np.argsort(flat, kind="stable")
    flat, place, document = flat[order], place[order], document[order]
    terms, first = np.unique(flat, return_index=True)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (document[1:] != document[:-1])
    doc_counts = np.add.reduceat(new.astype(np.int32), first) if len(first) else first.astype(np.int32)
    return {
        "doc_ids": ids,
        "text_keys": keys,
        "n_words": counts,
        "terms": terms.astype(np.int32),
        "doc_counts": doc_counts.astype(np.int32),
        "posting_ends": np.append(first[1:], len(flat)).astype(np.int32)[: len(terms)],
        "positions": place.tobytes(),
    }


def build_index(
    documents: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text",
    segment_words: int = SEGMENT_WORDS, gap: int = reach(WIDTH, SLOP),
) -> DataFrame:
    """One row per segment; terms outside ``vocabulary`` only take up positions."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        ids, keys, counts, numbers, size = [], [], [], [], 0

        def row():
            columns = {k: [v] for k, v in _segment(ids, keys, counts, numbers, gap).items()}
            return pa.RecordBatch.from_pydict(
                columns,
                schema=pa.schema(
                    {"doc_ids": pa.list_(pa.int64()), "text_keys": pa.list_(pa.int64()), "n_words": pa.list_(pa.int32()),
                     "terms": pa.list_(pa.int32()), "doc_counts": pa.list_(pa.int32()),
                     "posting_ends": pa.list_(pa.int32()), "positions": pa.binary()}
                ),
            )

        for batch in portions(batches):
            for name, body, key in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                found = words(body)
                ids.append(name)
                keys.append(key)
                counts.append(len(found))
                numbers.append(np.fromiter((known(w, -1) for w in found), np.int32, len(found)))
                size += len(found) + 1
                if size >= segment_words:
                    yield row()
                    ids, keys, counts, numbers, size = [], [], [], [], 0
        if ids:
            yield row()

    return documents.select(F.col(doc_id).cast("bigint"), text, F.xxhash64(text)).mapInArrow(index, INDEX_SCHEMA)


def document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each test term stands; one row per term, so bounded by the pass."""
    pairs = F.arrays_zip("terms", "doc_counts")
    counted = (
        index.select(F.explode(pairs).alias("p")).groupBy("p.terms").agg(F.sum("p.doc_counts").alias("n")).collect()
    )
    result = np.zeros(terms, np.int64)
    for row in counted:
        result[row.terms] = row.n
    return result


class _Segment:
    """Sorted (term, position) pairs of a segment; looking one up is a binary search."""

    def __init__(self, terms, ends, positions, vocabulary: int):
        sizes = np.diff(np.concatenate([[0], ends]))
        self.positions = positions.astype(np.int64)
        # The last key is above all others.
        self.keys = np.append((np.repeat(terms.astype(np.int64), sizes) << 32) | self.positions, np.iinfo(np.int64).max)
        self.first, self.size = np.zeros((2, vocabulary), np.int64)
        self.first[terms], self.size[terms] = ends - sizes, sizes

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.size[term]]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        return self.near(terms, positions, 0)

    def near(self, terms: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
        place = (terms.astype(np.int64) << 32) + positions
        return self.keys[np.searchsorted(self.keys, place - slop)] <= place + slop


def _plan(windows: Windows, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each window's words from rarest to commonest, and windows sorted by anchor."""
    frequency = np.where(windows.terms >= 0, counts[windows.terms], np.iinfo(np.int64).max)
    offsets = np.argsort(frequency, axis=1, kind="stable")
    anchors = windows.terms[np.arange(len(offsets)), offsets[:, 0]]
    return offsets, anchors


def _exact(segment: _Segment, windows: Windows, offsets: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(window, start) of exact matches."""
    order = np.argsort(anchors, kind="stable")
    terms, first = np.unique(anchors[order], return_index=True)
    ends = np.append(first[1:], len(order))
    exact = [np.empty((2, 0), np.int64)]
    for term, a, b in zip(terms.tolist(), first, ends):
        lists = segment.postings(term)
        # Positions of one term against its windows, in bounded pieces.
        for cut in range(0, len(lists), 65_536 // max(1, b - a) + 1):
            piece = lists[cut : cut + 65_536 // max(1, b - a) + 1]
            window = np.repeat(order[a:b], len(piece))
            start = np.tile(piece, b - a) - offsets[window, 0]
            for j in range(1, windows.terms.shape[1]):
                if not len(window):
                    break
                offset = offsets[window, j]
                term_j = windows.terms[window, offset]
                alive = (term_j < 0) | segment.has(term_j, start + offset)
                window, start = window[alive], start[alive]
            exact.append(np.stack([window, start]))
    return np.concatenate(exact, axis=1)


def _close(segment, windows, offsets, allowed, window, start, slop):
    """Of (window, start) those with at most ``allowed`` words away from their place, and how many are."""
    away = np.zeros(len(window), np.int32)
    for j in range(windows.terms.shape[1]):
        offset = offsets[window, j]
        term = windows.terms[window, offset]
        away += (term >= 0) & ~segment.near(term, start + offset, slop)
        kept = away <= allowed[window]
        window, start, away = window[kept], start[kept], away[kept]
    return window, start, away


def _near(segment: _Segment, windows: Windows, offsets: np.ndarray, slop: int) -> np.ndarray:
    """(window, start) of proximity matches, the best start of each."""
    allowed = windows.size - np.ceil(NEAR_SHARE * windows.size - 1e-9).astype(np.int32)
    window, j = np.nonzero(np.arange(windows.terms.shape[1]) <= allowed[:, None])
    several = windows.size[window] > 1
    window, offset = window[several], offsets[window[several], j[several]]
    term = windows.terms[window, offset]
    sizes = segment.size[term]
    found = [np.empty((3, 0), np.int64)]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        pair = np.repeat(np.arange(at, to), sizes[at:to])
        rank = np.arange(len(pair)) - (ends - sizes - done)[pair]
        at = to
        start = segment.positions[segment.first[term[pair]] + rank] - offset[pair]
        # The anchor may stand anywhere in the slop, so all others within twice of it.
        hit, start, _ = _close(segment, windows, offsets, allowed, window[pair], start, 2 * slop)
        hit = np.repeat(hit, 2 * slop + 1)
        start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        found.append(np.stack(_close(segment, windows, offsets, allowed, hit, start, slop)))
    window, start, away = np.unique(np.concatenate(found, axis=1), axis=1)
    if not len(window):
        return np.empty((2, 0), np.int64)
    # Windows one after the other, starts ascending: a new run where either jumps.
    run = np.cumsum(np.append(True, (np.diff(window) > 0) | (np.diff(start) > slop))) - 1
    whole = np.ones(len(window), bool)
    for k in range(windows.terms.shape[1]):
        term = windows.terms[window, k]
        whole &= (term < 0) | segment.has(term, start + k)
    exact = np.bincount(run, whole) > 0
    best = np.lexsort((start, away, run))
    best = best[np.append(True, np.diff(run[best]) > 0)]
    best = best[~exact[run[best]]]
    return np.stack([window[best], start[best]])


def _document_hits(row: dict, windows: Windows, offsets, anchors, slop: int, gap: int) -> Iterator[tuple]:
    counts = np.array(row["n_words"], np.int64)
    starts = _starts(counts, gap)
    segment = _Segment(
        np.array(row["terms"], np.int32), np.array(row["posting_ends"], np.int64), np.frombuffer(row["positions"], np.int32),
        len(windows.vocabulary),
    )
    exact = _exact(segment, windows, offsets, anchors)
    near = _near(segment, windows, offsets, slop) if slop and len(windows.terms) else np.empty((2, 0), np.int64)
    owner = np.searchsorted(starts, exact[1], "right") - 1
    # A near start may lie before its document, by less than the gap.
    near_owner = np.searchsorted(starts - (windows.terms.shape[1] - 1 + slop), near[1], "right") - 1
    close = [set() for _ in counts]
    for d, w, at in zip(near_owner.tolist(), near[0].tolist(), (near[1] - starts[near_owner]).tolist()):
        close[d].add((windows.ids[windows.item[w]], min(max(at, 0), int(counts[d]) - 1)))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(counts) + 1))
    for d, (name, key) in enumerate(zip(row["doc_ids"], row["text_keys"])):
        mine = order[cuts[d] : cuts[d + 1]]
        spans, items = [], []
        if len(mine):
            begin = exact[1][mine] - starts[d]
            end = begin + windows.size[exact[0][mine]]
            by = np.argsort(begin, kind="stable")
            begin, upto = begin[by], np.maximum.accumulate(end[by])
            fresh = np.concatenate([[True], begin[1:] > upto[:-1]])
            last = np.concatenate([fresh[1:], [True]])
            spans = np.stack([begin[fresh], upto[last]], axis=1).ravel().tolist()
            found = {windows.ids[i] for i in np.unique(windows.item[exact[0][mine]])}
            items = sorted(x for x in found if x is not None)
        places = sorted(close[d], key=lambda x: (x[1], x[0] is None, x[0] or ""))
        yield name, key, int(counts[d]), spans, items, [{"item": i, "start": a} for i, a in places], len(places)


def search(index: DataFrame, windows: Windows, slop: int = 0, gap: int = reach(WIDTH, SLOP)) -> DataFrame:
    """HITS_SCHEMA, one row per indexed document; spans are flat, merged [start, end) pairs."""
    counts = document_counts(index, len(windows.vocabulary))
    shared = index.sparkSession.sparkContext.broadcast((windows, *_plan(windows, counts)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, offsets, anchors = shared.value
        schema = pa.schema(
            {"doc_id": pa.int64(), "text_key": pa.int64(), "n_words": pa.int64(), "spans": pa.list_(pa.int32()),
             "items": pa.list_(pa.string()),
             "near": pa.list_(pa.struct({"item": pa.string(), "start": pa.int32()})), "n_near": pa.int64()}
        )
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                columns = list(zip(*_document_hits(row, tests, offsets, anchors, slop, gap)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return index.mapInArrow(look, HITS_SCHEMA)


def _passes(benchmark: DataFrame, item_id: str, text: str, pass_words: int) -> Iterator[list]:
    """The test items in lists of at most about ``pass_words`` words each."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("body"))
    kept, size = [], 0
    for row in items.toLocalIterator():
        body = row.body.encode()
        kept.append((row.id, body))
        size += len(words(body))
        if size >= pass_words:
            yield kept
            kept, size = [], 0
    yield kept


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slop: int = SLOP,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """HITS_SCHEMA: what every document shares with the benchmark."""
    found, gap = [], reach(width, slop)
    for items in _passes(benchmark, item_id, item_text, pass_words):
        windows = windows_of(items, width)
        if not len(windows.terms) and found:
            continue
        index = stored(build_index(documents, windows.vocabulary, doc_id, text, gap=gap), "postings")
        found.append(search(index, windows, slop, gap))
    return found[0] if len(found) == 1 else _merged(found)


def _by_start(a, b):
    less = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & F.coalesce(a["item"] < b["item"], a["item"].isNotNull()))
    return F.when(a == b, 0).when(less, -1).otherwise(1)


def _merged(found: list[DataFrame]) -> DataFrame:
    """Hits of several passes over the same documents.

    Every pass lists every row; rows with one id and text have the same hits, so
    they are merged by both and handed out as often as they came.
    """
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    grouped = whole.groupBy("doc_id", "text_key", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        F.count("*").alias("rows"),
    ).withColumns({"near": F.array_sort("near", _by_start), "n_near": F.size("near").cast("bigint")})
    copies = F.explode(F.sequence(F.lit(1), (F.col("rows") / len(found)).cast("int")))
    return grouped.select("*", copies.alias("copy")).drop("rows", "copy")


def _covered(spans):
    """Words inside the union of flat [start, end) pairs that may overlap."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)),
        lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b")),
    )
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    total = F.aggregate(
        F.array_sort(pairs),
        state,
        lambda s, p: F.struct(
            (s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["to"]))).alias("n"),
            F.greatest(s["to"], p["b"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return F.when(F.size(spans) > 0, total).otherwise(F.lit(0).cast("bigint"))


def judge(hits: DataFrame) -> DataFrame:
    """Add n_hit, n_items and ``contaminated``: a twentieth or more of the words are hit."""
    n_hit = _covered(F.col("spans"))
    return hits.select("*", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def uncontaminated(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    found = judge(find_contamination(documents, benchmark, doc_id, text, **options)).where("contaminated")
    bad = stored(found.select(F.struct("doc_id", "text_key").alias("row")), "contaminated")
    row = F.struct(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    return without(documents, row, bad, "row")
