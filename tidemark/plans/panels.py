"""Observation tables derived from the raw order and event tables.

Both are plain two-phase aggregations down to one row per (series, slot), so a
series that holds a third of all orders still reaches the shuffle as one row per
slot and map task.  Money is summed in whole cents: integer sums do not depend
on the order in which partial results arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.config import Engine

SERIES_KEYS = ("priority", "nation", "priority_nation")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _with_series(orders: DataFrame, spark: SparkSession, folder: str, key: str) -> DataFrame:
    if key == "priority":
        return orders.withColumn("series_id", F.col("o_orderpriority"))
    if key not in SERIES_KEYS:
        raise ValueError(f"unknown series key {key!r}; expected one of {SERIES_KEYS}")
    # left to the planner: it broadcasts the customers only if they are small
    nations = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("nation")
    )
    joined = orders.join(nations, "o_custkey")
    if key == "nation":
        return joined.withColumn("series_id", F.col("nation"))
    return joined.withColumn("series_id", F.concat_ws("/", "o_orderpriority", "nation"))


def order_observations(
    spark: SparkSession, folder: str, engine: Engine, key: str = "priority"
) -> DataFrame:
    """``series_id, ds, intake, release, load``: one row per series and order day.

    ``intake`` counts orders placed, ``release`` counts orders whose first line
    item ships that day, ``load`` is the mean order price in whole units.
    """
    shipped = (
        _table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("first_ship"))
    )
    orders = _with_series(_table(spark, folder, "orders"), spark, folder, key).select(
        "series_id",
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderdate").cast("date").alias("ds"),
        _cents(F.col("o_totalprice")).alias("cents"),
    )
    # one joined pass feeds both counts: an order is an arrival on its own day
    # and a departure on the day it first ships
    moves = (
        orders.join(shipped, "l_orderkey", "left")
        .select(
            "series_id",
            F.inline(
                F.array(
                    F.struct(F.col("ds"), F.lit(1).alias("arrived"), F.col("cents")),
                    F.struct(
                        F.col("first_ship").alias("ds"),
                        F.lit(0).alias("arrived"),
                        F.lit(None).cast("bigint").alias("cents"),
                    ),
                )
            ),
        )
        .filter(F.col("ds").isNotNull())
    )
    daily = moves.groupBy("series_id", "ds").agg(
        F.sum(F.col("arrived").cast("bigint")).alias("intake"),
        F.sum((1 - F.col("arrived")).cast("bigint")).alias("release"),
        F.sum("cents").alias("cents"),
    )
    # a day with departures alone is a reported one without a level
    return daily.select(
        "series_id",
        "ds",
        "intake",
        "release",
        F.bround(F.try_divide(F.col("cents"), F.lit(100.0) * F.col("intake"))).cast("bigint").alias("load"),
    )


def event_observations(spark: SparkSession, folder: str, engine: Engine) -> DataFrame:
    """Hourly observations per event type, over an all-hours calendar.

    ``intake`` counts events, ``release`` counts distinct users, ``load`` is the
    mean value in cents.
    """
    per_user = (
        _table(spark, folder, "events")
        .select(
            F.col("event_type").alias("series_id"),
            F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ds"),
            "user_id",
            _cents(F.col("value")).alias("cents"),
        )
        .groupBy("series_id", "ds", "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    )
    return per_user.groupBy("series_id", "ds").agg(
        F.sum("n").alias("intake"),
        F.count("user_id").alias("release"),
        F.bround(F.sum("cents") / F.sum("n").cast("double")).cast("bigint").alias("load"),
    )
