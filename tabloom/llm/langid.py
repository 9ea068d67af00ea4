"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Each language is a smoothed distribution over letter trigrams (hashed into ``BUCKETS`` classes),
counted over all labelled training documents.  A document's trigrams are taken as draws from a
mixture of languages; expectation-maximisation estimates the proportions.  Languages are
ranked by their share in the full mixture, the nested sets of the first one, two, … are fitted again, and
the set with the best penalised likelihood is kept.  The largest share of that
set is the prediction and its share the score.

The model holds ``BUCKETS`` numbers per language: bounded by the number of languages.  Scoring is done row by row.

Only text and label are read.  Defined cases: a NULL text, or one without letters, is ``und`` with
score 0 and no languages; with no training rows every text is ``und``; equal shares go to
the language first in order; very long texts are counted whole; other columns pass through, only
the result column replaces one of its own name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 6.0  # per language, times log of the trigram count: trigrams overlap by three
PIECE = 1 << 21  # characters worked on at once


class Model(NamedTuple):
    languages: list[str]
    log_chance: np.ndarray  # (languages, BUCKETS)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the trigrams with a letter, sorted by row and bucket."""
    rows, buckets, counts = [], [], []
    start = 0
    while start < len(texts):  # bounded pieces of whole texts
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 2
            end += 1
        zero = np.zeros(2, np.uint32)
        parts = [zero]
        for t in texts[start:end]:
            parts += [_codes(t), zero]
        codes = np.concatenate(parts)
        owner = np.repeat(np.arange(end - start), [len(t) + 2 for t in texts[start:end]])
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        some = (a | b | c) > 0
        h = a[some] * np.uint32(0x9E3779B1) ^ b[some] * np.uint32(0x85EBCA77) ^ c[some] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        key = (owner[: len(a)][some].astype(np.int64) << 16) | (h >> np.uint32(16)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        rows.append((key >> 16) + start)
        buckets.append(key & 0xFFFF)
        counts.append(n)
        start = end
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (rows, buckets, counts))


def fit(documents: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """Count trigrams of all rows with a language; ``documents`` are the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(0).to_pylist()]
            rows, buckets, counts = trigrams(texts)
            unique, place = np.unique(names, return_inverse=True)
            for i, name in enumerate(unique.tolist()):
                mine = place[rows] == i
                table = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                table += np.bincount(buckets[mine], counts[mine], BUCKETS).astype(np.int64)
        for name, table in sums.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used), pa.array(table[used])], names=["language", "bucket", "n"]
            )

    training = documents.where(F.col(language).isNotNull()).select(text, language)
    # At most BUCKETS rows per language.
    table = (
        training.mapInArrow(count, "language string, bucket bigint, n bigint")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(table["language"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        mine = table[table["language"] == name]
        counts[i, mine["bucket"].to_numpy(int)] = mine["n"].to_numpy(float)
    chance = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(languages, np.log(chance).astype(np.float32))


def _mixture(likelihood: np.ndarray, counts: np.ndarray, first: np.ndarray, rows: np.ndarray, active: np.ndarray):
    """Expectation-maximisation of many documents at once: shares and log likelihood.

    ``likelihood`` is (trigrams, languages), scaled by each trigram's best language;
    ``active`` (documents, languages) says which languages a document may hold.
    """
    share = active / np.maximum(active.sum(axis=1, keepdims=True), 1)
    totals = np.add.reduceat(counts, first)[:, None]
    for _ in range(ROUNDS):
        joint = likelihood * share[rows]
        whole = joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint * (counts[:, None] / np.maximum(whole, 1e-30)), first, axis=0) / totals
    whole = (likelihood * share[rows]).sum(axis=1)
    return share, np.add.reduceat(counts * np.log(np.maximum(whole, 1e-30)), first)


def mixtures(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(places of texts with letters, their language shares), unselected languages 0."""
    rows, buckets, counts = trigrams(texts)
    if not len(rows) or not model.languages:
        return np.empty(0, int), np.empty((0, len(model.languages)))
    known, first, place = np.unique(rows, return_index=True, return_inverse=True)
    log = model.log_chance[:, buckets].T
    likelihood = np.exp(log - log.max(axis=1, keepdims=True))
    counts = counts.astype(np.float32)
    totals = np.add.reduceat(counts, first)
    full, value = _mixture(likelihood, counts, first, place, np.ones((len(known), len(model.languages)), np.float32))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_value = None, None
    for size in range(1, len(model.languages) + 1):
        active = (rank < size).astype(np.float32)
        share, value = _mixture(likelihood, counts, first, place, active) if size < len(model.languages) else (full, value)
        penalised = value - PENALTY * (size - 1) * np.log(totals + 1)
        if best is None:
            best, best_value = share, penalised
            continue
        better = penalised > best_value
        best = np.where(better[:, None], share, best)
        best_value = np.where(better, penalised, best_value)
    return known, best


def language_of(documents: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of lang (largest share or ``und``), score (that share) and all shares kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    entry = pa.struct({"lang": pa.string(), "share": pa.float64()})

    @F.arrow_udf("struct<lang:string,score:double,shares:array<struct<lang:string,share:double>>>")
    def predict(column: pa.Array) -> pa.Array:
        fitted = shared.value
        names = fitted.languages
        texts = [t or "" for t in column.to_pylist()]
        lang, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE):
                size += len(texts[end])
                end += 1
            known, found = mixtures(texts[start:end], fitted)
            found = found / np.maximum(found.sum(axis=1, keepdims=True), 1e-30)
            for row, share in zip((known + start).tolist(), found):
                top = int(np.argmax(share))
                lang[row], score[row] = names[top], min(1.0, float(share[top]))
                shares[row] = [
                    {"lang": names[i], "share": float(share[i])} for i in np.argsort(-share, kind="stable") if share[i] > 1e-3
                ]
            start = end
        return pa.StructArray.from_arrays(
            [pa.array(lang), pa.array(score, pa.float64()), pa.array(shares, pa.list_(entry))], ["lang", "score", "shares"]
        )

    return predict.asNondeterministic()(F.col(text))


def annotate(documents: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    return documents.withColumn(into, language_of(documents, model, text))
