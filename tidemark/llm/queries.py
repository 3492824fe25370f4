"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import chat_roles, decontamination, imatch, language, merkle, near_dedup, periodic_runs, substring_dedup, topk, toxicity, warc_index
from tidemark.llm.common import table
from tidemark.llm.sentence_pieces import encode_decode
from tidemark.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    made = encode_decode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    # written as JSON, [1,2,3], the ids of a long text need no string each
    listed = F.to_json("ids")
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.substr(listed, F.lit(2), F.length(listed) - 2), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)).cast("long") == F.col("n_bytes"), F.col("n_bytes") == 0).alias("spans_cover_text"),
    )


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = remainder(4) == 2
    made = language.identify(table(spark, folder, "documents"), held_out)
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), remainder(5) == 0
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out)
    made = toxicity.score(docs, model)
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op5_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op8_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CHECKS["op8_spaced_seeds"] = decontamination.SQL


@query
def op7_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op6_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    made = warc_index.archive_and_read(table(spark, folder, "pages"), payloads=False)
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHECKS["op6_capture_index"] = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT *, CASE WHEN payload_bytes >= {warc_index.LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM kept
"""


@query
def op2_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


CHECKS["op2_norm_buckets"] = topk.SQL


@query
def op1_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_roles.repaired_turns(table(spark, folder, "conversations"))


CHECKS["op5_minhash_forest"] = near_dedup.SQL


@query
def op11_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, folder, "documents"))


CHECKS["op11_imatch"] = imatch.SQL


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(table(spark, folder, "documents"))


CHECKS["op12_merkle_manifest"] = merkle.SQL


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    made = periodic_runs.detect(table(spark, folder, "documents"), planted=True)
    # the greatest length/period without fractions: compared crosswise
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return made.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
