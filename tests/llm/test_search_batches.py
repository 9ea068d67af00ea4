"""Batches of queries in a search shard: the same scores as one by one, and hits that don't grow with the shards."""

import numpy as np
import pytest

from tabloom.llm import search

DOCUMENTS, TERMS = 1_000, 400


def shard_of(seed=5):
    """Some terms in most documents, most in few; copies of a document, documents without words."""
    rng = np.random.default_rng(seed)
    tf = rng.poisson(1.5 / (np.arange(TERMS) + 1) ** 0.7, (DOCUMENTS, TERMS)).astype(np.int32)
    tf[:, 7] *= 300  # more than a byte holds
    tf[40:90], tf[90:95] = tf[3], 0
    lengths = tf.sum(axis=1).astype(np.float64)
    terms, docs = np.nonzero(tf.T)
    counts = np.bincount(terms, minlength=TERMS)
    kept = np.flatnonzero(counts)
    average = float(lengths.mean())
    shard = search.Shard(
        np.arange(DOCUMENTS) * 3, lengths, kept, counts[kept], docs.astype(np.int32), tf.T[terms, docs], average
    )
    gains = tf * 2.2 / (tf + (1.2 * (0.25 + 0.75 * lengths / average))[:, None])
    return shard, gains[:, kept]


@pytest.mark.parametrize("cells", [search.DENSE_CELLS, 3_000, 0])
def test_a_batch_finds_the_best_of_full_scoring(monkeypatch, cells):
    monkeypatch.setattr(search, "DENSE_CELLS", cells)
    shard, gains = shard_of()
    rng = np.random.default_rng(8)
    asked = [rng.choice(len(shard.terms), n, replace=False) for n in (300, 200, 60, 9, 2, 1, 0, 250)]
    weights = [rng.uniform(0.001, 9, len(a)) for a in asked]
    whole = np.array([gains[:, a] @ w for a, w in zip(asked, weights)])
    k = 10
    kth = np.sort(whole, axis=1)[:, -k]
    for floors in (np.zeros(8), kth, kth * 0.7, np.array([0, 1e9, *kth[2:]])):
        found = {q: (docs, scores) for q, docs, scores in shard.search_batch(asked, weights, floors, k)}
        for q, scores in enumerate(whole):
            docs, got = found.get(q, (np.empty(0, int), np.empty(0)))
            least = max(kth[q], floors[q])
            assert set(np.flatnonzero((scores > 0) & (scores >= least))) <= set(docs.tolist())
            assert len(set(docs.tolist())) == len(docs) and np.allclose(got, scores[docs], rtol=1e-12)
            assert (got > 0).all()


def test_frequent_terms_leave_few_postings():
    """What is summed posting by posting is what seldom terms hold."""
    shard, _ = shard_of()
    counts = shard.ends - shard.starts
    frequent = shard.frequent.row >= 0
    assert frequent.any() and counts[~frequent].sum() * 4 < counts.sum()


def test_hits_do_not_grow_with_the_shards(spark):
    rows = [(i, f"common words here w{i % 50} v{i % 7}") for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(48)
    index = search.build_index(docs)
    queries = [f"w{i} common v{i % 7}" for i in range(20)]
    split = search._Terms()
    terms = [split(q.encode())[0] for q in queries]
    vocabulary, places = np.unique(np.concatenate(terms), return_inverse=True)
    ends = np.cumsum([len(t) for t in terms])
    block = search.QueryBlock(np.arange(20), ends, vocabulary, places.astype(np.int32), np.ones(len(places)), 5.0, 10)
    hits = search._search_block(index, block).groupBy("query_key").count().collect()
    assert len(hits) == 20
    assert max(r["count"] for r in hits) <= 10 * spark.sparkContext.defaultParallelism
