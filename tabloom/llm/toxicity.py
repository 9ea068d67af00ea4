"""Toxicity grades by cumulative-link ordinal regression on sparse word counts.

Grades are 0 … K-1.  P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector
``w`` for all thresholds ``theta_0 < theta_1 < …``; the expected severity is the sum
of P(grade > k).  ``x`` holds log(1 + count) of the words in a vocabulary that is
learnt from the labels: words in at least ``MIN_DOCUMENTS`` that stand more often in documents above
grade 0, by a likelihood ratio whose share of false finds among all words tried is at most ``FALSE_SHARE``
(Benjamini-Hochberg, so few words on few texts need less evidence each), at most ``VOCABULARY`` of them; a
text without any gets the base rate.  Labels of only 0 and 1 are refined first: a toxic document with more
of these words than the median toxic one that has some is grade 2.

Fitting uses at most ``FIT_ROWS`` labelled documents (those with the smallest hash of
their id), a documented bound; every document is scored on its whole text.

Defined cases: NULL and empty texts have no words and get the base rate; several
labels of one document count as the highest; NULL labels are ignored; with no labelled
rows, or only one grade, nothing is rejected; repeated documents are scored alike; other
columns pass through, only the result column replaces one of its own name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bloom import free_names
from tabloom.llm.words import portions, stored, utf8, words

FIT_ROWS = 20_000
VOCABULARY = 4_096
FALSE_SHARE = 0.01
MIN_DOCUMENTS = 5
L2 = 1e-5
REJECT_AT = 0.25


class Model(NamedTuple):
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades


def grades_from_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic; the fit refines it by the words."""
    return labels.where(F.col("toxic").isNotNull()).groupBy(doc_id).agg(F.max("toxic").alias("grade"))


def refined(grade: np.ndarray, weight: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Grades 0 and 1 to 0, 1 and 2: above the median evidence of the rows that have some."""
    evidence = np.bincount(row, value, len(grade))
    some = np.flatnonzero((grade == 1) & (evidence > 0))
    if not len(some):
        return grade
    order = some[np.argsort(evidence[some], kind="stable")]
    upto = np.cumsum(weight[order])
    median = evidence[order][np.searchsorted(upto, upto[-1] / 2)]
    return np.where((grade == 1) & (evidence > median), 2, grade)


def _fit_sample(documents: DataFrame, grades: DataFrame, rows: int, doc_id: str, text: str) -> DataFrame:
    chosen = grades.where(F.col("grade").isNotNull() & F.col(doc_id).isNotNull()).orderBy(
        F.xxhash64(doc_id), doc_id
    ).limit(rows)
    # At most ``rows`` narrow rows.
    rows = documents.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(text, F.col("grade").cast("int"))
    # Copies of one text tell no more than one of them does.
    return rows.dropDuplicates([text, "grade"])


def _vocabulary(sample: DataFrame, size: int, false_share: float) -> tuple[dict[bytes, int], np.ndarray]:
    """The words most associated with grades above 0, and the number of documents by grade."""
    by_grade = sample.groupBy("grade").count().collect()
    counts = np.zeros(max([r.grade for r in by_grade], default=0) + 1)
    for r in by_grade:
        counts[r.grade] = r["count"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for body, grade in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                distinct = set(words(body))
                seen.update(distinct)
                if grade > 0:
                    toxic.update(distinct)
            yield pa.RecordBatch.from_pydict(
                {"word": list(seen), "n": list(seen.values()), "above": [toxic[w] for w in seen]},
                schema=pa.schema({"word": pa.binary(), "n": pa.int64(), "above": pa.int64()}),
            )

    total, above = float(counts.sum()), float(counts[1:].sum())
    n, a = F.sum("n").cast("double"), F.sum("above").cast("double")
    words_ = sample.mapInArrow(count, "word binary, n bigint, above bigint").groupBy("word").agg(n.alias("n"), a.alias("a"))
    words_ = stored(words_.where(F.col("n") >= MIN_DOCUMENTS), "toxicity-words")

    def cell(found: Column, in_words: Column, in_grade: float) -> Column:
        return F.when(found > 0, found * F.log(found * total / (in_words * in_grade))).otherwise(0.0)

    n, a, below = F.col("n"), F.col("a"), total - above
    ratio = 2 * (
        cell(a, n, above) + cell(n - a, n, below)
        + cell(above - a, total - n, above) + cell(below - n + a, total - n, below)
    )
    best = (
        words_.where(a * total > n * above).withColumn("ratio", ratio)
        .orderBy(F.desc("ratio"), "word").limit(size).collect()
    )
    chance = np.array([math.erfc(math.sqrt(max(r.ratio, 0.0) / 2)) / 2 for r in best])
    allowed = false_share * np.arange(1, len(best) + 1) / max(words_.count(), 1)
    best = best[: int(np.max(np.flatnonzero(chance <= allowed), initial=-1)) + 1]
    return {bytes(r.word): i for i, r in enumerate(best)}, counts


def _features(sample: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Grade, row, word and value arrays of the bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [Counter(known[w] for w in words(b) if w in known) for b in utf8(batch.column(0))]
            yield pa.RecordBatch.from_pydict(
                {"grade": batch.column(1), "word": [list(c) for c in found], "n": [list(c.values()) for c in found]},
                schema=pa.schema({"grade": pa.int32(), "word": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}),
            )

    # Equal rows are counted before they leave the executors.
    rows = (
        sample.mapInArrow(sparse, "grade int, word array<int>, n array<int>")
        .groupBy("grade", "word", "n").agg(F.count("*").alias("rows")).orderBy("grade", "word", "n").collect()
    )
    sizes = [len(r.word) for r in rows]
    flat = lambda name: np.array([x for r in rows for x in r[name]], np.float64)
    return (
        np.array([r.grade for r in rows], np.int64), np.array([r.rows for r in rows], np.float64),
        np.repeat(np.arange(len(rows)), sizes), flat("word").astype(np.int64), np.log1p(flat("n")),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(
    grade: np.ndarray, weight: np.ndarray, row: np.ndarray, word: np.ndarray, value: np.ndarray, words_: int,
    grades: int, l2: float = L2, steps: int = 400,
) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam; thresholds are a first cut plus positive gaps."""
    share = np.array([weight[grade <= k].sum() for k in range(grades - 1)]) / weight.sum()
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    parameters = np.concatenate([np.zeros(words_), start[:1], gaps])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    total = weight.sum()
    for step in range(1, steps + 1):
        w, cut, gap = parameters[:words_], parameters[words_], np.exp(parameters[words_ + 1 :])
        theta = cut + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(row, w[word] * value, len(grade))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = (_sigmoid(edges[grade + i] - score) for i in (1, 0))
        inside = np.maximum(upper - lower, 1e-12)
        slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
        slope_u[grade == grades - 1] = 0.0
        slope_l[grade == 0] = 0.0
        by_score = weight * (slope_u - slope_l) / inside / total
        g_theta = np.array(
            [
                -(weight * (np.where(grade == k, slope_u, 0) - np.where(grade == k + 1, slope_l, 0)) / inside).sum() / total
                for k in range(grades - 1)
            ]
        )
        tail = np.cumsum(g_theta[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(word, by_score[row] * value, words_) + l2 * w, tail[:1], tail[1:] * gap]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1))
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gap = np.exp(parameters[words_ + 1 :])
    return parameters[:words_], parameters[words_] + np.concatenate([[0.0], np.cumsum(gap)])


def fit(
    documents: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS,
    vocabulary: int = VOCABULARY, false_share: float = FALSE_SHARE,
) -> Model:
    sample = _fit_sample(documents, grades, rows, doc_id, text)
    known, counts = _vocabulary(sample, vocabulary, false_share)
    if (counts > 0).sum() < 2 or not known:  # nothing to tell apart
        return Model({}, np.zeros(0), np.array([40.0]))
    grade, weight, row, word, value = _features(sample, known)
    if len(counts) == 2:
        grade = refined(grade, weight, row, value)
    weights, thresholds = fit_cumulative_link(grade, weight, row, word, value, len(known), int(grade.max()) + 1)
    return Model(known, weights, thresholds)


def grade_probabilities(model: Model, score: np.ndarray) -> np.ndarray:
    """P(grade > k) for every row and threshold."""
    return _sigmoid(score[:, None] - model.thresholds[None, :])


def severity(documents: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of severity (expected grade), grade (most likely), p_toxic (above 0) and evidence
    (known words found)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity:double,grade:int,p_toxic:double,evidence:int>")
    def score(column: pa.Array) -> pa.Array:
        fitted = shared.value
        known, weights = fitted.vocabulary, fitted.weights
        scores, evidence = np.zeros(len(column)), np.zeros(len(column), np.int32)
        for i, body in enumerate(b for part in portions([column]) for b in utf8(part)):
            found = [known[w] for w in words(body) if w in known]
            if found:
                evidence[i] = len(found)
                scores[i] = sum(weights[k] * np.log1p(n) for k, n in Counter(found).items())
        above = grade_probabilities(fitted, scores)
        edges = np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))])
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)),
             pa.array(above[:, 0]), pa.array(evidence)],
            ["severity", "grade", "p_toxic", "evidence"],
        )

    return score.asNondeterministic()(F.col(text))  # so that a filter on it doesn't run it twice


def annotate(documents: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    return documents.withColumn(into, severity(documents, model, text))


def rejected(into: str = "toxicity", reject_at: float = REJECT_AT) -> Column:
    """Toxic enough, by words of its own: a base rate alone rejects nothing."""
    return (F.col(f"{into}.evidence") > 0) & (F.col(f"{into}.p_toxic") >= reject_at)


def accepted(
    documents: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", reject_at: float = REJECT_AT
) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    model = fit(documents, grades, doc_id, text)
    (into,) = free_names(documents, "_toxicity")
    return annotate(documents, model, text, into).where(~rejected(into, reject_at)).select(*documents.columns)
