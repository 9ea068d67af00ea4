"""How much of the texts a stage of the pipeline hands to Python at a time."""

import pyarrow as pa
import pytest

import corpus_pipeline
from tabloom.llm import packing, pii, words


@pytest.mark.parametrize("stage, module, operator", [("pii", pii, "redacted"), ("packing", packing, "pack_documents")])
def test_stages_hand_over_bounded_batches(spark, tmp_path, monkeypatch, stage, module, operator):
    was = spark.conf.get(corpus_pipeline.BATCH_BYTES)
    spark.range(800).selectExpr("id AS doc_id", "repeat('many words ', 3000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents")

    def sizes(docs, *args, **options):
        def measure(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

        return docs.select("doc_id", "text").mapInArrow(measure, "n bigint, size bigint")

    monkeypatch.setattr(module, operator, sizes)
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents")
        rows = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).collect()
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BYTES, was)
    assert sum(r.n for r in rows) == 800 and len(rows) >= 5
    assert max(r.size for r in rows) <= 1.1 * words.PORTION_BYTES
