"""Digests of files and tables, provenance records, and their comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import ship_package


RANGE_BYTES = 64 << 20
LIMB = 1 << 32


def _range_digest(path: str, offset: int, size: int) -> str:
    where, name = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with where.open_input_file(name) as data:
        data.seek(offset)
        while size:
            part = data.read(min(size, 4 << 20))
            if not part:
                raise OSError(f"{path} ended {size} bytes early")
            digest.update(part)
            size -= len(part)
    return digest.hexdigest()


def file_digests(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Digest, length and number of byte ranges of every file under ``paths``.

    A file is cut into ranges that tasks read and hash on their own; its digest is the SHA-256 of the range digests in order,
    joined by line ends.  No cell holds a range, let alone a file.  Spark lists no empty files, so those have no row.
    """
    ship_package(spark)
    # the listing alone: without ``content`` no file is opened
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    last = F.greatest(F.floor((F.col("length") - 1) / range_bytes), F.lit(0))
    ranges = files.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    tasks = max(1, ranges.count())
    ranges = ranges.repartition(min(tasks, 10_000), "path", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                _range_digest(path, place * range_bytes, min(range_bytes, length - place * range_bytes))
                for path, length, place in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "place")))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "sha256"])

    hashed = ranges.mapInArrow(read, "path string, length long, place long, sha256 string")
    parts = F.array_sort(F.collect_list(F.struct("place", "sha256")))["sha256"]
    return hashed.groupBy("path", "length").agg(F.count("*").alias("n_ranges"), F.sha2(F.array_join(parts, "\n"), 256).alias("tree_sha256")).select(
        F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("file"), "length", "n_ranges", "tree_sha256"
    )


def row_digests(master: DataFrame) -> DataFrame:
    """SHA-256 of every row's canonical text; NULL is spelled out, never skipped."""
    columns = [c for c in master.columns if c != "series_id"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return master.select("series_id", "pos", F.sha2(text, 256).alias("row_sha256"))


def series_digests(master: DataFrame) -> DataFrame:
    """One digest per series over its row digests in slot order.

    A series is one row per calendar slot, so its list of digests is bounded.
    """
    return row_digests(master).groupBy("series_id").agg(
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_sha256"))), lambda x: x["row_sha256"]),
                "\n",
            ),
            256,
        ).alias("series_sha256")
    )


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table of any size, by one associative aggregate: rows count as often as they occur.

    Each row's SHA-256 gives four 32-bit numbers, and each of the four is summed modulo 2^32.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    digest = F.sha2(text, 256)
    limbs = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"limb_{k}") for k in range(4)]
    sums = df.select(*limbs).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"limb_{k}").alias(f"limb_{k}") for k in range(4)])
    parts = [F.lpad(F.lower(F.hex((F.coalesce(f"limb_{k}", F.lit(0)) % LIMB).cast("long"))), 8, "0") for k in range(4)]
    return sums.select("n_rows", F.concat(*parts).alias("digest"))


def provenance(master: DataFrame) -> DataFrame:
    """Digest, sizes and first/last date of every series."""
    counts = master.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_period_positions"),
        F.count_if(~F.col("is_imputed")).alias("n_real_observations"),
        F.count_if("is_imputed").alias("n_gap_slots"),
        F.max("ds").alias("data_as_of"),
        F.min("ds").alias("series_starts"),
    )
    return counts.join(series_digests(master), "series_id")


def compare_provenance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Field by field: does every series carry the same record on both sides?"""
    fields = [c for c in left.columns if c != "series_id"]
    a = left.select("series_id", *[F.col(c).cast("string").alias(f"a_{c}") for c in fields])
    b = right.select("series_id", *[F.col(c).cast("string").alias(f"b_{c}") for c in fields])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.col(f"a_{c}").alias("left_value"), F.col(f"b_{c}").alias("right_value"),
            F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias("matches"),
        )
        for c in fields
    ])
    return a.join(b, "series_id", "full").select("series_id", F.inline(rows))
