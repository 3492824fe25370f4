"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame.  All but the last return the
columns of documents: doc_id, text, lang, source, n_chars.  Results are written as Parquet and read again as the next
stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontamination, near_dedup, sentence_pieces, substring_dedup, toxicity
from tidemark.llm.common import prepare, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BESIDES = ("lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the nearest labelled examples; unscored ones stay."""
    prepare(spark)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model, evidence=0, carry=("text", *BESIDES)).filter(F.col("score") < 0.5).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, 128 bits of the id and the text: ids may repeat or be null, so rows are chosen by it."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.withColumn("row_key", F.md5(F.concat(name, F.when(F.col("text").isNull(), "-").otherwise(":"), F.coalesce("text", F.lit("")))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; empty documents and null ids stay.

    Of rows with the same id and text one stays.  Where an id has several texts, each is judged for itself.
    """
    prepare(spark)
    rows = keyed(docs)
    found = near_dedup.near_duplicates(rows, carry=("row_key",))
    kept = found.filter("kept").select("row_key").distinct()
    return rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; a document that was nothing else goes."""
    prepare(spark)
    made = substring_dedup.remove_repeats(docs, carry=BESIDES)
    left = (F.col("removed_bytes") == 0) | (F.length(F.trim("text")) > 0)
    return made.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; rows without an id are judged like others."""
    prepare(spark)
    rows = keyed(docs)
    leaks = decontamination.overlaps(rows, table(spark, sf_dir, "benchmark"), key="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their spans, and whether decoding them gives the text again."""
    prepare(spark)
    made = sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("text", "lang", "source"))
    return made.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("benchmark leaks", without_leaks),
    ("sentence pieces", pieces),
]

# Nearest neighbours, content-defined chunks and BPE merges cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "after-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
