"""What a search shard holds in a Python worker."""

import tracemalloc

import numpy as np

from tabloom.llm import search


def test_shard_memory_stays_near_its_postings():
    lists, documents = 60, 50_000
    n = lists * documents
    docs = np.tile(np.arange(documents, dtype=np.int32), lists)
    tf = (np.arange(n) % 7 + 1).astype(np.int32)
    lengths = np.random.default_rng(3).integers(50, 500, documents).astype(np.float64)
    weight = np.linspace(0.1, 2, lists)
    tracemalloc.start()
    shard = search.Shard(np.arange(documents), lengths, np.arange(lists), np.full(lists, documents), docs, tf, 200.0)
    built = tracemalloc.get_traced_memory()[1]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    found, scores = shard.search(np.arange(lists), weight, 0.0)
    searched = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert held < 12 * n and built < 40 * n and searched < 12 * n
    norm = 1.2 * (1 - 0.75 + 0.75 * lengths / 200.0)
    assert np.array_equal(shard.gain, tf * 2.2 / (tf + norm[docs]))
    whole = np.bincount(docs, np.repeat(weight, documents) * shard.gain, documents)
    assert np.array_equal(found, np.arange(documents)) and np.allclose(scores, whole, rtol=1e-12)
    floor = np.sort(whole)[-10]
    best, high = shard.search(np.arange(lists), weight, float(floor))
    assert set(np.flatnonzero(whole >= floor)) <= set(best.tolist()) and np.allclose(high, whole[best], rtol=1e-12)
