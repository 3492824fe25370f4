"""Raw header CSV of daily observations: long dates, thousands separators, blank tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.config import Engine

DATE_PATTERN = "MMMM d, yyyy"


def read_raw(
    spark: SparkSession, path: str, columns: list[str], expected_rows: int | None = None
) -> DataFrame:
    """All-string scan, failing fast on missing columns or an unexpected row count.

    Types are never inferred: blank rows and separators would turn counts into
    floats or text depending on the sample.  A blank line keeps its row, with its
    place in the file.
    """
    present = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"raw file lacks column(s) {missing}; found {present}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in present])
    rows = spark.read.option("header", True).schema(schema).csv(path)
    if expected_rows is not None:
        found = rows.count()
        if found != expected_rows:
            raise ValueError(f"expected {expected_rows} raw rows, found {found}")
    # files are packed into partitions by size, so the row's place comes from its file and block, then the id
    return rows.withColumn(
        "file_order",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def drop_blank(rows: DataFrame) -> DataFrame:
    """Drop rows without any value; the file order does not count as one."""
    return rows.na.drop("all", subset=[c for c in rows.columns if c != "file_order"])


def blank_tail(rows: DataFrame) -> DataFrame:
    """How many rows are blank, where the first is, and whether all are at the end."""
    named = [F.col(c).isNull() for c in rows.columns if c != "file_order"]
    blank = named[0]
    for extra in named[1:]:
        blank = blank & extra
    table = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(blank).alias("n_blank"),
        F.min(F.when(blank, F.col("file_order"))).alias("first_blank"),
        F.max(F.when(~blank, F.col("file_order"))).alias("last_filled"),
    )
    return table.select(
        "n_rows", "n_blank", "first_blank",
        F.coalesce(F.col("last_filled") < F.col("first_blank"), F.lit(True)).alias("blank_tail_contiguous"),
    )


def parse_date(text: Column, pattern: str = DATE_PATTERN) -> Column:
    """NULL where the text is not a date."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def parse_count(text: Column) -> Column:
    """Whole number with optional thousands separators; NULL where it is not one."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("bigint")


def observations(rows: DataFrame, engine: Engine, names: dict[str, str]) -> DataFrame:
    """``series_id, ds, <measures>`` from raw rows; ``names`` maps our names to theirs."""
    return drop_blank(rows).select(
        F.col(names["series_id"]).alias("series_id"),
        parse_date(F.col(names["ds"])).alias("ds"),
        *[parse_count(F.col(names[m])).alias(m) for m in engine.measure_names],
    )


def parse_failures(rows: DataFrame, engine: Engine, names: dict[str, str]) -> DataFrame:
    """Texts that were present but could not be read, per column."""
    filled = drop_blank(rows)

    def lost(c: str, read: Column) -> Column:
        return F.count_if(F.col(c).isNotNull() & read.isNull())

    return filled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        lost(names["ds"], parse_date(F.col(names["ds"]))).alias("failed_ds"),
        *[lost(names[m], parse_count(F.col(names[m]))).alias(f"failed_{m}") for m in engine.measure_names],
        *[F.count_if(F.contains(F.col(names[m]), F.lit(","))).alias(f"separated_{m}") for m in engine.measure_names],
    )


def as_raw_text(obs: DataFrame, engine: Engine) -> DataFrame:
    """Observations spelled the way a raw file spells them."""
    return obs.select(
        "series_id",
        F.date_format("ds", DATE_PATTERN).alias("Date"),
        *[F.format_number(F.col(m), 0).alias(m) for m in engine.measure_names],
    )


def write_raw(obs: DataFrame, path: str, engine: Engine, blank_rows: int = 0) -> None:
    """Newest first, separators in the numbers, blank rows at the end.

    Range-partitioning by date keeps the files in order without one big task; the
    blank rows carry the oldest key and so land in the last file.
    """
    text = as_raw_text(obs, engine).withColumn("ds", parse_date(F.col("Date")))
    blanks = obs.sparkSession.range(blank_rows).select(
        *[F.lit(None).cast("string").alias(c) for c in text.columns if c != "ds"],
        F.lit("0001-01-01").cast("date").alias("ds"),
    )
    ordered = text.unionByName(blanks).orderBy(F.col("ds").desc(), "series_id").drop("ds")
    ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
