"""Sinks and scans of engine tables: Parquet, CSV, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def write_table(df: DataFrame, path: str, partition_by: tuple = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Published CSV with a header; NULL is an empty field."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, producer: str) -> DataFrame:
    """Typed scan of a published CSV; a missing one names the step that makes it."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"missing artifact {path}; produce it with: {producer}")
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# The nested registry document, one row per run.
_DIAGNOSTIC = T.StructType([T.StructField(n, T.DoubleType()) for n in (
    "bias", "mae", "bias_ratio", "ci_low", "ci_high")] + [
    T.StructField("n", T.LongType()), T.StructField("significant", T.BooleanType())])
_STABILITY = T.StructType([T.StructField("n", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in (
    "error_median", "error_iqr", "error_p90", "tail_ratio")])
_BOOTSTRAP = T.StructType([T.StructField("n", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in (
    "mean_difference", "ci_low", "ci_high")] + [T.StructField("distinguishable", T.BooleanType())])
_NAMES = T.ArrayType(T.StringType())

ENTRY = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("horizon", T.IntegerType()), T.StructField("champion", T.StringType()),
    T.StructField("champion_mae", T.DoubleType()), T.StructField("numerical_leader", T.StringType()),
    T.StructField("numerical_leader_mae", T.DoubleType()), T.StructField("reason", T.StringType()),
    T.StructField("champion_full_dev", T.StringType()), T.StructField("champion_full_dev_mae", T.DoubleType()),
    T.StructField("full_dev_numerical_leader", T.StringType()), T.StructField("full_dev_n", T.LongType()),
    T.StructField("rankings_agree", T.BooleanType()), T.StructField("governing_scope_note", T.StringType()),
    T.StructField("n_scored", T.LongType()), T.StructField("selection_scope", T.StringType()),
    T.StructField("window_rule", T.StringType()), T.StructField("gate_cleared_by", _NAMES),
    T.StructField("tied_with_best", _NAMES), T.StructField("bias_screened_out", _NAMES),
    T.StructField("full_dev_ranking", T.ArrayType(T.StructType([
        T.StructField("MAE", T.DoubleType()), T.StructField("model", T.StringType())]))),
    T.StructField("bias_diagnostics", T.MapType(T.StringType(), _DIAGNOSTIC)),
    T.StructField("stability_diagnostics", T.MapType(T.StringType(), _STABILITY)),
    T.StructField("bootstrap_evidence", T.MapType(T.StringType(), _BOOTSTRAP)),
])


def registry_entries(selection: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested entry per (series, metric, horizon): the decision and its evidence.

    Entries stay rows, so the registry of a million series is a partitioned JSON
    table and never one document in one task.
    """
    key = ["series_id", "metric", "horizon"]
    judged = F.col("tied") | ~F.col("any_passed")

    def by_model(keep, value) -> Column:
        return F.map_from_entries(
            F.array_sort(F.collect_list(F.when(keep, F.struct("model", value.alias("v")))))
        )

    bias = F.struct(
        "bias", F.col("MAE").alias("mae"), "bias_ratio", F.col("bias_low").alias("ci_low"),
        F.col("bias_high").alias("ci_high"), F.col("n_points").alias("n"),
        F.col("bias_significant").alias("significant"),
    )
    spread = F.struct(F.col("n_points").alias("n"), "error_median", "error_iqr", "error_p90", "tail_ratio")
    against = F.struct(
        F.col("n_points").alias("n"), "mean_difference", F.col("diff_low").alias("ci_low"),
        F.col("diff_high").alias("ci_high"), "distinguishable",
    )
    compared = F.col("any_passed") & F.col("viable") & (F.col("model") != F.col("leader.model"))
    maps = evidence.groupBy(*key).agg(
        by_model(judged, bias).alias("bias_diagnostics"),
        by_model(judged, spread).alias("stability_diagnostics"),
        by_model(compared, against).alias("bootstrap_evidence"),
    )
    joined = selection.join(maps, key, "left")
    return joined.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY.fields])


def registry_document(entries: DataFrame, rule: dict, provenance: DataFrame) -> DataFrame:
    """Entries as JSON text with the rule and the provenance of their series attached."""
    steps = F.struct(*[F.lit(v).alias(k) for k, v in rule.items()])
    facts = provenance.select("series_id", F.struct(*[c for c in provenance.columns if c != "series_id"]).alias("provenance"))
    return entries.join(facts, "series_id", "left").select(
        "series_id", "metric", "horizon",
        F.to_json(F.struct(steps.alias("selection_rule"), "provenance", F.struct(*entries.columns).alias("entry"))).alias("document"),
    )
