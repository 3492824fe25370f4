"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import ship_package, stage

__all__ = ["arrow_map", "carried", "documents", "loaded", "prepare", "stage", "table"]

# Rows of one Arrow batch.  Texts run to 100 kB and more; 256 of the longest still
# fit a worker's memory, which the default of 10,000 would not.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the rows of an Arrow batch."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """The id, the text with null read as empty, and named further columns; all others go."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def arrow_map(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str,
) -> DataFrame:
    """Apply ``work`` to every Arrow batch; ``None`` and empty batches yield nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


@functools.lru_cache(maxsize=8)
def loaded(make: Callable, *args):
    """One instance per Python worker of something costly to build."""
    return make(*args)


def carried(schema: str, base: DataFrame, names: tuple) -> str:
    """The schema with the named columns of ``base`` put after it."""
    kinds = dict(base.dtypes)
    return ", ".join([schema, *(f"`{n}` {kinds[n]}" for n in names)])
