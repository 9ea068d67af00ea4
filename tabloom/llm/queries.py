"""The registered query of every operator; the digest columns are derived here."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    alignment, decontamination, dedup, jaccard, langid, licenses, packing, pii, repair, search, sharding, toxicity, urls,
)
from tabloom.llm.words import id_crc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_pii_semi_crf")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.annotate(_table(spark, folder, "documents").select("doc_id", "text"), into="spans")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, partial(operator.eq, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


@_query("op2_sampled_splitters")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_by_size(_table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op3_language_mixture")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = langid.fit(documents.where(~held_out))
    found = langid.annotate(documents.select("doc_id", "text", held_out.alias("held_out")), model, into="language")
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.transform("language.shares", lambda s: s["lang"]).alias("languages"),
    )


@_query("op4_toxicity_ordinal")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = toxicity.fit(documents, toxicity.grades_from_labels(_table(spark, folder, "labels")))
    graded = toxicity.annotate(documents.select("doc_id", "text"), model, into="toxicity")
    return graded.select(
        "doc_id", "toxicity.severity", "toxicity.grade", "toxicity.p_toxic", toxicity.rejected().alias("toxic")
    )


@_query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, folder, "documents")))


@_query("op6_cutting_stock_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path())


@_query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return decontamination.judge(hits).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated", "n_near", "near",
    )


@_query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_classes(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op9_bm25_block_max_wand")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return search.top_k(documents, documents.where(F.col("doc_id") % 20 == 0)).select(
        F.col("query_id").alias("doc_id"), "rank", "hit_id", "score"
    )


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_FITS = "(h.host = r.r_host OR ends_with(h.host, '.' || r.r_host)) AND starts_with(h.path, r.r_path)"
URLS_SQL = f"""
WITH rests AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM rests),
h AS (SELECT page_id, row_number() OVER () AS n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM hosts),
r AS (SELECT * FROM (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}) AS t(verdict, r_host, r_path)),
best AS (SELECT n, arg_max(r.r_host || r.r_path, length(r.r_host || r.r_path)) AS rule,
         arg_max(r.verdict, length(r.r_host || r.r_path)) AS verdict FROM h JOIN r ON {_FITS} GROUP BY n)
SELECT h.page_id, h.host, h.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM h LEFT JOIN best ON h.n = best.n
"""


@_query("op10_url_bloom_filter", URLS_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), urls.rule_table(spark, urls.RULES))


DEDUP_SQL = r"""
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS points, row_number() OVER () AS r,
              sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM bare WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST, r)
"""


@_query("op11_fuse_filter_dedup", DEDUP_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return dedup.deduplicate(documents, dedup.by_arrival(), dedup.BATCHES)


def alignment_files() -> alignment.Files:
    import public_tokenizers

    at = public_tokenizers.path
    return alignment.Files(
        at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, at("piece_bpe_32k.model")
    )


@_query("op12_pair_bitmap_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = alignment.align(_table(spark, folder, "documents"), alignment_files())
    return found


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them; dropped ones are marked ``gone``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    lot = (F.crc32(key.cast("binary")) % 20).alias("lot")
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), lot)
    return rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("lot") == 0).alias("gone"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


@_query("op13_branch_and_bound_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(damaged(_table(spark, folder, "conversations")), gone=F.col("gone"))
