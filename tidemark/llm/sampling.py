"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SPREAD = 1 << 30


def labelled_sample(docs: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """At most ``most`` different texts of each value of ``label``, and the rows each value has.

    Texts are chosen by their hash, so equal texts count once and the choice depends on content alone.
    A threshold on the hash, from the exact counts, thins the rows before any window sees them.
    Returns (doc_id, text, label) and {value: rows}.  Rows with a null label are left out.
    """
    rows = docs.filter(F.col(label).isNotNull()).select("doc_id", label, F.xxhash64("text").alias("h"))
    totals = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not totals:
        return docs.select("doc_id", "text", label).filter(F.lit(False)), {}
    distinct = rows.groupBy(label, "h").agg(F.min("doc_id").alias("doc_id"))
    # few different texts among many copies still leave enough: the threshold follows the different ones
    kinds = {r[0]: r[1] for r in distinct.groupBy(label).count().collect()}
    share = F.create_map(*[F.lit(x) for v, n in kinds.items() for x in (v, min(SPREAD, 4 * most * SPREAD // n))])
    near = distinct.filter(F.pmod(F.col("h"), F.lit(SPREAD)) <= share[F.col(label)])
    order = Window.partitionBy(label).orderBy(F.pmod(F.col("h"), F.lit(SPREAD)), "h")
    chosen = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    # bounded by ``most`` for each value, so it may be sent to every task
    chosen = F.broadcast(chosen.select("doc_id", label, "h"))
    sample = (
        docs.select("doc_id", "text", label).withColumn("h", F.xxhash64("text"))
        .join(chosen, ["doc_id", label, "h"]).dropDuplicates([label, "h"]).drop("h")
    )
    return sample, totals
