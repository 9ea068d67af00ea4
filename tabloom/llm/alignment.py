"""Alignment of two tokenizers through inverted pair bitmaps.

The tokens of both lie over the same bytes; offsets where both end cut them into groups, and every A token is
linked with every B token of its group.  For each linked pair of ids the index keeps, per block of at most 65,536 documents,
compressed bitmaps of the documents by multiplicity: plane k has the documents whose number of such links has bit k set.  A
bitmap is a sorted list of 16-bit numbers below 4,096 members, else 8 KB of bits.  Bitmaps of a block's slices are OR-merged when
the block closes; OR-merging a pair's planes and counting bits gives its documents, weighted counts of the planes its
links.  The postings then return the scores: every block's bitmaps meet the corpus-wide counts of their pairs and are read
back into sums per document.

A text is cut at single spaces in front of a visible character, where neither tokenizer ever joins: A starts a token at such
a space, and no piece of B has a space inside.  Each different chunk of a slice is tokenised and grouped once.

Memory: a task holds one slice of ``SLICE_CHARS`` (one text at least) and the postings of a block, ``BLOCK_POSTINGS`` and one slice at
most.  A pair that stands in very many blocks meets its count by broadcast (``skew.join_weighted``), others by shuffle; pairs are bounded
by the two vocabularies.  Nothing of the corpus passes through the driver.

Defined cases: a text that is NULL, empty, or not rendered back byte by byte by either tokenizer (B's normaliser, a U+2581 of its own) has
no tokens and gets zeros; very long texts are taken whole; repeated rows are documents of their own; ties for an A
id's most frequent partner all count as best; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.words import stored
from tabloom.plans.skew import join_weighted

SLICE_CHARS = 4_000_000
BLOCK_DOCUMENTS = 1 << 16
BLOCK_POSTINGS = 6_000_000
ARRAY_MEMBERS = 4096
# A space that stays with what follows: a visible character behind it and no space before.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = re.compile(r" [^\S ]")  # a space before other white space
# Visible at both ends, and of letters and signs that all regular-expression engines agree on.
PLAIN = re.compile(r"[!-~À-ɏ](?:[\x00-\x7FÀ-ɏ]*[!-~À-ɏ])?\Z")
B_SHIFT = 20  # a pair is (A id << B_SHIFT) | B id


@dataclass(frozen=True)
class Files:
    """Paths of the vocabularies: A as tokenizer file and as rank file, with its pattern; B as piece model."""

    a: str
    a_ranks: str
    a_pattern: str
    b: str


class Tokenizers:
    """Ids of both tokenizers for whole chunks, and the bytes of every id."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.a_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("a", pat_str=files.a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.a = Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        with open(files.a, encoding="utf-8") as body:
            top = max(json.load(body)["model"]["vocab"].values())
        self.a_bytes = [b""] * (max(top, self.a.get_vocab_size() - 1) + 1)
        for piece, number in ranks.items():
            self.a_bytes[number] = piece
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode_a(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has.

        The rank file holds the same vocabulary; characters its engine may class otherwise go to A itself.
        """
        is_plain = np.array([PLAIN.match(c) is not None for c in chunks], bool)
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        # Plain chunks in a row are one text, as every one starts a token; their bytes tell where each ends.
        whole = " " + " ".join([chunks[i] for i in plain.tolist()]) if len(plain) else ""
        joined = np.array(self.ranked.encode_ordinary(whole), np.int64)
        size = np.array([len(chunks[i].encode()) + 1 for i in plain.tolist()], np.int64)
        stops = np.searchsorted(np.cumsum(self.a_size[joined]), np.cumsum(size)) + 1
        counts = np.zeros(len(chunks), np.int64)
        counts[plain] = np.diff(stops, prepend=0)
        if not len(other):
            return joined, counts
        rest = [e.ids for e in self.a.encode_batch([" " + chunks[i] for i in other.tolist()], add_special_tokens=False)]
        counts[other] = list(map(len, rest))
        owner = np.concatenate([np.repeat(plain, counts[plain]), np.repeat(other, counts[other])])
        return np.concatenate([joined, _flat(rest)])[np.argsort(owner, kind="stable")], counts

    def encode_b(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.b.encode(list(chunks), num_threads=1)
        return _flat(ids), np.fromiter(map(len, ids), np.int64, len(ids))


def _flat(lists: Sequence[Sequence[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 … for each start, ``counts`` numbers long, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _whole(table: list[bytes], sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, chunks: Sequence[str]) -> np.ndarray:
    """Which chunks, with a space before, their tokens' bytes give back."""
    bodies = [b" " + c.encode() for c in chunks]
    owner = np.repeat(np.arange(len(chunks)), counts)
    same = np.bincount(owner, sizes[ids], minlength=len(chunks)) == np.fromiter(map(len, bodies), np.int64, len(bodies))
    pieces = [table[i] for i in ids.tolist()]
    if same.all() and b"".join(pieces) == b"".join(bodies):
        return same
    ends = np.cumsum(counts)
    return np.array([b"".join(pieces[e - n : e]) == body for n, e, body in zip(counts.tolist(), ends.tolist(), bodies)], bool)


def cut(text: str) -> list[str]:
    """The chunks of a text that isn't empty."""
    if "  " in text or text[0] == " " or text[-1] == " " or ODD.search(text):
        return CUT.split(text)
    return text.split(" ")


class Aligner:
    """Groups and links of chunks and of the documents made of them."""

    def __init__(self, files: Files):
        self.t = Tokenizers(files)
        # Decimal ids with each of the separators.
        most = max(len(self.t.a_size), len(self.t.b_size))
        self.width = most
        self.written = [f"{i}{sep}" for sep in ",|;" for i in range(most)]

    def chunks(self, chunks: Sequence[str]) -> dict[str, np.ndarray | list]:
        """Of each chunk: valid, n_a, n_b, n_groups, n_links, the groups written out, and its linked pairs with multiplicity."""
        (ids_a, n_a), (ids_b, n_b) = self.t.encode_a(chunks), self.t.encode_b(chunks)
        valid = _whole(self.t.a_bytes, self.t.a_size, ids_a, n_a, chunks)
        valid &= _whole(self.t.b_bytes, self.t.b_size, ids_b, n_b, chunks)
        ids_a, ids_b = ids_a[np.repeat(valid, n_a)], ids_b[np.repeat(valid, n_b)]
        n_a, n_b = n_a * valid, n_b * valid
        end_a, end_b = np.cumsum(self.t.a_size[ids_a]), np.cumsum(self.t.b_size[ids_b])
        common = end_a[np.isin(end_a, end_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        per_a, per_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        owner_a, owner_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        first_b = np.cumsum(per_b) - per_b
        # Groups end where chunks end, as both tokenizers do.
        group_owner = owner_b[first_b] if len(first_b) else np.zeros(0, np.int64)
        links = per_b[group_a]
        left = np.repeat(ids_a, links)
        right = ids_b[_spread(first_b[group_a], links)]
        return {
            "valid": valid, "n_a": n_a, "n_b": n_b,
            "n_groups": np.bincount(group_owner, minlength=len(chunks)),
            "n_links": np.bincount(np.repeat(owner_a, links), minlength=len(chunks)),
            "groups": self._written(ids_a, ids_b, group_a, group_b, n_a + n_b),
            **self._pairs(np.repeat(owner_a, links), left << B_SHIFT | right, len(chunks)),
        }

    def _written(self, ids_a, ids_b, group_a, group_b, counts) -> list[str]:
        """``a1,a2|b1;`` for the groups of each chunk."""
        ids = np.concatenate([ids_a, ids_b])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        place = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        ids, side, place = ids[order], side[order], place[order]
        last = np.append(place[1:] != place[:-1], True)[: len(place)]
        parts = [self.written[i] for i in (np.where(last, 1 + side, 0) * self.width + ids).tolist()]
        ends = np.cumsum(counts)
        return ["".join(parts[s:e]) for s, e in zip((ends - counts).tolist(), ends.tolist())]

    @staticmethod
    def _pairs(owner: np.ndarray, pair: np.ndarray, chunks: int) -> dict[str, np.ndarray]:
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair)))
        n_pairs = np.bincount(owner[at], minlength=chunks)
        return {"pair": pair[at], "times": times, "n_pairs": n_pairs, "first_pair": np.cumsum(n_pairs) - n_pairs}

    def documents(self, texts: Sequence[str], first: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Figures of every text, and the postings (pair << 16 | document number, links) of all, from number ``first`` on."""
        cuts = [cut(t) if t else [] for t in texts]
        counts = np.array(list(map(len, cuts)), np.int64)
        coded = pa.array([c for cut in cuts for c in cut], pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        made = self.chunks(coded.dictionary.to_pylist())
        document = np.repeat(np.arange(len(texts)), counts)
        broken = np.bincount(document, ~made["valid"][which], minlength=len(texts)) > 0
        rows, ends = [], np.cumsum(counts)
        sums = {n: np.bincount(document, made[n][which], minlength=len(texts)).astype(np.int64).tolist() for n in ("n_a", "n_b", "n_groups", "n_links")}
        listed = which.tolist()
        for i, (s, e) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
            if s == e or broken[i]:
                rows.append((0, 0, 0, 0, ""))
                continue
            groups = "".join([made["groups"][c] for c in listed[s:e]])[:-1]
            rows.append((*[sums[n][i] for n in ("n_a", "n_b", "n_groups", "n_links")], hashlib.sha256(groups.encode()).hexdigest()))
        good = ~broken[document]
        key, times = np.unique(document[good] * len(made["valid"]) + which[good], return_counts=True)
        document, chunk = np.divmod(key, max(1, len(made["valid"])))
        counts = made["n_pairs"][chunk]
        at = _spread(made["first_pair"][chunk], counts)
        postings = made["pair"][at] << 16 | np.repeat(document + first, counts)
        return rows, *_summed(postings, made["times"][at] * np.repeat(times, counts))


def _summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their amounts."""
    order = np.argsort(keys)
    keys, amounts = keys[order], amounts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(amounts, at) if len(at) else amounts


def bitmap(members: np.ndarray) -> bytes:
    """Sorted 16-bit numbers as a list, or as bits where that is smaller."""
    if len(members) < ARRAY_MEMBERS:
        return members.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCUMENTS, bool)
    bits[members] = True
    return np.packbits(bits, bitorder="little").tobytes()


def members(held: bytes) -> np.ndarray:
    if len(held) < 2 * ARRAY_MEMBERS:
        return np.frombuffer(held, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))


def planes(keys: np.ndarray, links: np.ndarray) -> pa.Table:
    """(a, b, n_docs, n_links, planes) of a block's postings; keys are (pair << 16 | document), sorted."""
    pair = keys >> 16
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    owner = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(pair))))
    most = np.maximum.reduceat(links, at) if len(at) else links
    depth = np.ceil(np.log2(most + 1)).astype(np.int64)  # planes of each pair
    first = np.cumsum(depth) - depth
    place, document = [], []
    for k in range(int(depth.max(initial=0))):
        has = links >> k & 1 == 1
        place.append(first[owner[has]] + k)
        document.append((keys[has] & 0xFFFF).astype(np.uint16))
    place, document = np.concatenate(place or [np.zeros(0, np.int64)]), np.concatenate(document or [np.zeros(0, np.uint16)])
    order = np.argsort(place, kind="stable")
    document = document[order]
    sizes = np.bincount(place, minlength=int(depth.sum()))
    ends = np.cumsum(sizes)
    maps = [bitmap(document[s:e]) for s, e in zip((ends - sizes).tolist(), ends.tolist())]
    # The union of a pair's planes are its documents, as every number of links has a bit.
    return pa.table(
        {
            "a": pa.array((pair[at] >> B_SHIFT).astype(np.int32)), "b": pa.array((pair[at] & (1 << B_SHIFT) - 1).astype(np.int32)),
            "n_docs": pa.array(np.bincount(owner, minlength=len(at))),
            "n_links": pa.array(np.add.reduceat(links, at) if len(at) else links),
            "planes": pa.ListArray.from_arrays(pa.array(np.append(first, depth.sum()), pa.int32()), pa.array(maps, pa.binary())),
        }
    )


def scores(held: Sequence[Sequence[bytes]], count: np.ndarray, best: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every document of a block, the links whose pair is a best one, and the sum of counts over its links."""
    n_best, sums = np.zeros(documents, np.int64), np.zeros(documents, np.int64)
    maps = [(members(m), k, i) for i, row in enumerate(held) for k, m in enumerate(row)]
    if maps:
        sizes = [len(m) for m, _, _ in maps]
        document = np.concatenate([m for m, _, _ in maps]).astype(np.int64)
        weight = np.repeat(np.array([1 << k for _, k, _ in maps], np.int64), sizes)
        row = np.repeat(np.array([i for _, _, i in maps]), sizes)
        np.add.at(sums, document, weight * count[row])
        np.add.at(n_best, document, weight * best[row])
    return n_best, sums


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def index(documents: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: rows of documents (block, number, doc_id, figures) and of postings (block, a, b, n_docs, n_links, planes)."""
    kind = documents.schema[doc_id].dataType.simpleString()
    names = f"block bigint, number int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    schema = names + ", a int, b int, n_docs bigint, pair_links bigint, planes array<binary>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files)
        block, number = TaskContext.get().partitionId() << 32, 0
        keys: list[np.ndarray] = []
        links: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            # Slices hold different documents: their bitmaps are merged by sorting what they hold together.
            if keys:
                merged = planes(*_summed(np.concatenate(keys), np.concatenate(links)))
                yield from _postings(merged, block, kinds)
            keys.clear()
            links.clear()

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            texts = batch.column(1)
            start = 0
            while start < len(batch):
                stop, room = start, SLICE_CHARS
                while stop < len(batch) and number + stop - start < BLOCK_DOCUMENTS and (room > 0 or stop == start):
                    room -= len(texts[stop].as_py() or "")
                    stop += 1
                part = [t or "" for t in texts.slice(start, stop - start).to_pylist()]
                rows, key, link = aligner.documents(part, number)
                keys.append(key)
                links.append(link)
                yield _figures(rows, batch.column(0).slice(start, stop - start), block, number)
                number, start = number + len(part), stop
                if number == BLOCK_DOCUMENTS or sum(map(len, keys)) > BLOCK_POSTINGS:
                    yield from closed()
                    block, number = block + 1, 0
        yield from closed()

    made = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, schema)
    return stored(made.withColumn("posting", F.col("a").isNotNull()), "alignment")


def _figures(rows: list[tuple], ids: pa.Array, block: int, number: int) -> pa.RecordBatch:
    n = len(rows)
    *figures, digest = zip(*rows)
    none = [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()))]
    columns = [pa.array(np.full(n, block)), pa.array(np.arange(number, number + n, dtype=np.int32)), ids]
    columns += [pa.array(c, pa.int64()) for c in figures] + [pa.array(digest, pa.string()), *none]
    return pa.RecordBatch.from_arrays(columns, names=["block", "number", "doc_id", *FIGURES, "groups_sha256", *POSTING])


POSTING = ["a", "b", "n_docs", "pair_links", "planes"]


def _postings(made: pa.Table, block: int, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    for part in made.to_batches(max_chunksize=50_000):
        n = len(part)
        none = [pa.nulls(n, k) for k in (pa.int32(), key, *[pa.int64()] * 4, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), *none, *part.columns], names=["block", "number", "doc_id", *FIGURES, "groups_sha256", *POSTING]
        )


def pair_counts(indexed: DataFrame) -> DataFrame:
    """(a, b, count, links, blocks, best): how many documents hold a pair linked; whether no partner of its A id has more."""
    pairs = indexed.where("posting").groupBy("a", "b").agg(
        F.sum("n_docs").alias("count"), F.sum("pair_links").alias("links"), F.count("*").alias("blocks")
    )
    # As many rows as pairs of ids at most, whatever the corpus.
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return pairs.join(most, "a").withColumn("best", F.col("count") == F.col("most")).drop("most")


def align(documents: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pairs of ``pair_counts``."""
    indexed = index(documents, files, doc_id, text)
    pairs = stored(pair_counts(indexed), "pairs")
    # Only the keys of the bitmaps go to their counts; the bitmaps go to their block once.
    keys = indexed.where("posting").select("block", "a", "b")
    known = join_weighted(keys, pairs.select("a", "b", "count", "best", "blocks"), ["a", "b"], "blocks")
    kind = indexed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def gather(rows: pa.Table, counted: pa.Table) -> pa.Table:
        is_posting = rows.column("posting").to_numpy()
        held, rows = rows.filter(pa.array(is_posting)), rows.filter(pa.array(~is_posting))
        # Both sides have every pair of the block once.
        ours, theirs = (np.lexsort((t.column("b").to_numpy(), t.column("a").to_numpy())) for t in (held, counted))
        count, best = np.zeros(len(ours), np.int64), np.zeros(len(ours), np.int64)
        count[ours], best[ours] = counted.column("count").to_numpy()[theirs], counted.column("best").to_numpy()[theirs]
        number = rows.column("number").to_numpy()
        n_best, sums = scores(held.column("planes").to_pylist(), count, best, int(number.max(initial=-1)) + 1)
        columns = [rows.column(n) for n in ("doc_id", *FIGURES)]
        columns += [pa.array(n_best[number], pa.int64()), pa.array(sums[number], pa.int64()), rows.column("groups_sha256")]
        return pa.table(columns, names=["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    rows = indexed.select("block", "posting", "number", "doc_id", *FIGURES, "groups_sha256", "a", "b", "planes")
    # Fresh column ids: both sides stem from the index.
    counted = known.select(*[F.col(c).alias(c) for c in ("block", "a", "b", "count", "best")])
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(gather, schema), pairs
