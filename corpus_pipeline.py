"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

Each stage works on all rows its predecessor kept, and its decisions take effect: toxic documents
go, one document of each near-duplicate group stays, contaminated documents go, personal data
is replaced in the texts, and what is left is packed into sequences.

Rows are whole texts, so the stages bound the Arrow batches between Spark and Python by bytes, for the session they
run in; Spark's own bound is 64 MB, which both sides hold several times over for every core.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontamination, jaccard, packing, pii, toxicity
from tabloom.llm.queries import tokenizer_path
from tabloom.llm.words import PORTION_BYTES, stored

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.grades_from_labels(_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, _table(spark, sf_dir, "benchmark"), slop=0)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, length="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


def in_small_batches(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, str(PORTION_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("ngram_jaccard", in_small_batches(drop_near_duplicates)),
    ("decontamination", in_small_batches(drop_contaminated)),
    ("pii", in_small_batches(redact_personal_data)),
    ("packing", in_small_batches(pack_sequences)),
]

# Fitted models and packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
