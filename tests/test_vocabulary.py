"""Terms are counted by neighbouring words, in one shuffle."""

import re
from collections import Counter
from math import log, sqrt

import pytest

from tabloom.operators import features

TEXTS = ["The cat sat, the cat ran", None, "a b c", "cat", "", "sat the_cat the cat", "ran ran ran"]


def terms(text):
    words = [w for w in re.findall(r"\w{2,}", (text or "").lower())]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_vocabulary_reads_one_shuffle(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "word int, text string").repartition(3)
    total = Counter(t for text in TEXTS for t in terms(text))
    for size in (3, 6, 100):
        found = features.vocabulary(df, "text", size)
        rows = [(r["term"], r["total"]) for r in found.collect()]
        assert rows == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_weights_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "word int, text string").repartition(3)
    total = Counter(t for text in TEXTS for t in terms(text))
    vocab = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:6]]
    want = {}
    for key, text in enumerate(TEXTS):
        tf = Counter(t for t in terms(text) if t in vocab)
        seen = {t: sum(t in terms(other) for other in TEXTS) for t in tf}
        w = {t: n * (log((1 + len(TEXTS)) / (1 + seen[t])) + 1) for t, n in tf.items()}
        want |= {(key, t): v / sqrt(sum(x * x for x in w.values())) for t, v in w.items()}
    found = {(r["word"], r["term"]): r["weight"] for r in features.tfidf(df, "word", "text", 6).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
