"""The pipeline's stages one by one against plain versions, and as a whole."""

from collections import Counter

import brute
import corpus_pipeline
from tabloom.llm import pii

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()

    rows = {r.doc_id: r.text for r in docs.collect()}
    unique = stages["ngram_jaccard"](spark, docs, FOLDER)
    want = {i for i, (n, c) in brute.jaccard_components(list(rows.items())).items() if c == i or n == 0}
    assert unique.columns == columns and Counter(r.doc_id for r in unique.collect()) == Counter(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, FOLDER)
    judged = zip(rows, brute.contamination(rows.values(), items))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, (*_, bad) in judged if not bad}

    safe = stages["pii"](spark, docs, FOLDER)
    assert safe.columns == columns
    for r in safe.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(rows[r.doc_id]) and "[" not in r.text:
            assert r.text == rows[r.doc_id]


def test_run_packs_what_is_kept(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r.doc_id for r in rows}
    assert 0 < len(ids) < spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r["length"]
    assert all(tokens[r.doc_id] == r.doc_tokens for r in rows)


CLASHES = ["_KEY", "_block", "_maybe", "_w0", "_dropped", "row", "_copy", "_toxicity", "component_id", "text_key"]


def test_stages_keep_extra_columns(spark):
    """Whatever their names, in any case, with copies and with rows that go."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0"))  # the same rows again
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, docs.doc_id * 100 + i)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        kept = stages[name](spark, docs, FOLDER)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        rows = kept.collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in CLASHES] == [r.doc_id * 100 + i for i in range(len(CLASHES))], name
    packed = stages["packing"](spark, docs, FOLDER)
    assert not set(CLASHES) & set(packed.columns)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
