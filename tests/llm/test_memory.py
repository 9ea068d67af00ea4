"""What a Python worker holds at a time."""

import pyarrow as pa

from tabloom.llm import jaccard, words


def test_portions_are_bounded_and_whole():
    texts = [f"{i} " + "x" * 20_000 for i in range(1_000)] + [None]
    column = pa.array(texts, pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_001)), column], names=["doc_id", "text"])
    slices = list(words.portions([batch, batch]))
    assert len(slices) >= 8 and max(s.nbytes for s in slices) <= 1.1 * words.PORTION_BYTES
    assert [x for s in slices for x in s.column(1).to_pylist()] == 2 * texts
    assert pa.concat_arrays(list(words.portions([column]))).equals(column)
    assert [len(s) for s in words.portions([column[:0], column[:1]])] == [0, 1]


def test_shingler_forgets_words():
    shingles = jaccard.Shingler()
    for i in range(400):
        shingles(b" ".join(b"word%d" % j for j in range(1_000 * i, 1_000 * (i + 1))))
    assert len(shingles.memo) <= 101_000
