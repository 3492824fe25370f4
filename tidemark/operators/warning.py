"""Trailing-percentile early warning and its replay over past origins.

Threshold and first crossing are both read at the origin row: the first from a
trailing frame, the second from ``lead`` offsets.  Neither needs a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.operators.cleaning import by_metric
from tidemark.functions.intervals import capacity_label

TP, FP, FN, TN = "true_positive", "false_positive", "false_negative", "true_negative"


def _observed() -> Column:
    return F.when(~F.col("is_imputed"), F.col("value"))


def thresholds(panel: DataFrame, engine: Engine, percentiles: tuple | None = None) -> DataFrame:
    """Percentile of the observed values in the trailing window ending at each slot.

    With several percentiles the frame is evaluated once for all of them.
    """
    frame = by_metric().rowsBetween(-(engine.warn_window - 1), Window.currentRow)
    if percentiles is None:
        one = F.percentile(_observed(), F.lit(engine.warn_percentile)).over(frame)
        return panel.select("series_id", "metric", "pos", one.alias("threshold"))
    many = F.percentile(_observed(), F.array(*[F.lit(p) for p in percentiles])).over(frame)
    levels = F.array(*[F.lit(p) for p in percentiles])
    return panel.select("series_id", "metric", "pos", many.alias("levels")).select(
        "series_id", "metric", "pos",
        F.inline(F.arrays_zip(levels.alias("percentile"), F.col("levels").alias("threshold"))),
    )


def watch(
    panel: DataFrame, engine: Engine, percentiles: tuple | None = None, origins_only: bool = False
) -> DataFrame:
    """Per slot and percentile: threshold and the offset of the first later crossing.

    Only observed values inside the lookahead count as a crossing.
    ``origins_only`` keeps the slots that can be a fold origin.
    """
    w = by_metric()
    reach = max(h for h, _ in engine.tiers)
    frame = w.rowsBetween(-(engine.warn_window - 1), Window.currentRow)
    grid = percentiles or (engine.warn_percentile,)
    base = panel.select(
        "series_id", "metric", "pos",
        F.percentile(_observed(), F.array(*[F.lit(p) for p in grid])).over(frame).alias("levels"),
        F.array(*[F.lead(_observed(), k).over(w) for k in range(1, reach + 1)]).alias("ahead"),
    )
    if origins_only:
        first = engine.first_origin_history - 1
        base = base.filter((F.col("pos") >= first) & ((F.col("pos") - first) % engine.fold_step == 0))
    levels = F.array(*[F.lit(p) for p in grid])
    each = base.select(
        "series_id", "metric", "pos", "ahead",
        F.posexplode(levels).alias("i", "percentile"), "levels",
    ).withColumn("threshold", F.get("levels", F.col("i")))
    hit = F.array_position(
        F.transform("ahead", lambda v: F.coalesce(v > F.col("threshold"), F.lit(False))), F.lit(True)
    )
    return each.select(
        "series_id", "metric", "pos", "percentile", "threshold",
        F.when(F.col("threshold").isNotNull() & (hit > 0), hit.cast("int")).alias("crossing_offset"),
    )


def classify(crossed: DataFrame, keys: list[str], engine: Engine) -> DataFrame:
    """Tiers fired per origin from ``horizon, forecast, threshold`` rows.

    The highest tier is that of the shortest crossing horizon, the earliest that
    of the longest.
    """
    names = F.create_map(*[F.lit(x) for h, t in engine.tiers for x in (h, t)])
    known = F.col("horizon").isin(*[h for h, _ in engine.tiers])
    fires = F.when(
        known & F.coalesce(F.col("forecast") > F.col("threshold"), F.lit(False)), F.col("horizon")
    )
    longest = max(h for h, _ in engine.tiers)
    table = crossed.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.min(fires).alias("_short"),
        F.max(fires).alias("_long"),
        F.array_sort(F.collect_list(fires)).alias("_all"),
    )
    note = (
        F.when(F.col("threshold").isNull(), F.lit("threshold_missing"))
        .when(F.col("_short").isNull(), F.lit("no_tier"))
        .when(F.col("_short") == longest, F.lit("longest_horizon_only"))
        .otherwise(F.format_string("%s:%d", names[F.col("_short")], F.col("_short")))
    )
    return table.select(
        *keys, "threshold",
        F.col("_short").isNotNull().alias("fired"),
        names[F.col("_short")].alias("highest_tier"),
        names[F.col("_long")].alias("earliest_tier"),
        F.array_join(F.transform("_all", lambda h: h.cast("string")), ",").alias("fired_horizons"),
        note.alias("confidence_note"),
    )


def outcome(fired: Column, crossing: Column, threshold: Column) -> Column:
    return F.when(
        threshold.isNotNull(),
        F.when(fired & crossing.isNotNull(), F.lit(TP))
        .when(fired, F.lit(FP))
        .when(crossing.isNotNull(), F.lit(FN))
        .otherwise(F.lit(TN)),
    )


def replay(
    points: DataFrame, champions: DataFrame, panel: DataFrame, engine: Engine,
    percentiles: tuple | None = None,
) -> DataFrame:
    """Champion forecasts of every origin against the threshold known there."""
    key = ["series_id", "metric", "horizon"]
    chosen = points.join(
        champions.select(*key, F.col("champion").alias("model")), [*key, "model"]
    ).select(*key, "fold_id", "origin_pos", "origin_date", F.col("y_pred").alias("forecast"))
    seen = watch(panel, engine, percentiles, origins_only=True).withColumnRenamed("pos", "origin_pos")
    joined = chosen.join(seen, ["series_id", "metric", "origin_pos"])
    keys = ["series_id", "metric", "fold_id", "origin_pos", "origin_date", "percentile", "crossing_offset"]
    tiers = classify(joined, keys, engine)
    wide = joined.groupBy("series_id", "metric", "fold_id", "percentile").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("forecast"))).alias(f"forecast_h{h}") for h in engine.horizons]
    )
    result = outcome(F.col("fired"), F.col("crossing_offset"), F.col("threshold"))
    return tiers.join(wide, ["series_id", "metric", "fold_id", "percentile"]).select(
        "series_id", "metric", "fold_id", "origin_pos", "origin_date", "percentile", "threshold",
        "fired", "highest_tier", "earliest_tier", "fired_horizons", result.alias("outcome"),
        F.when(result == TP, F.col("crossing_offset")).alias("lead_time"),
        *[f"forecast_h{h}" for h in engine.horizons],
    )


def summarise(backtest: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, lead times and rates.  The false-positive rate divides by *fired*,
    the false-negative rate by *silent* origins."""
    def count(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    table = backtest.filter(F.col("outcome").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_origins"),
        *[count(n).alias(n) for n in (TP, FP, FN, TN)],
        F.percentile("lead_time", F.lit(0.5)).alias("median_surge_lead_time"),
        F.min("lead_time").alias("min_surge_lead_time"),
        F.max("lead_time").alias("max_surge_lead_time"),
    )
    fired = F.col(TP) + F.col(FP)
    silent = F.col(TN) + F.col(FN)
    return table.select(
        "*",
        fired.alias("n_fired"),
        F.try_divide(F.col(FP).cast("double"), fired.cast("double")).alias("false_positive_rate"),
        F.try_divide(F.col(FN).cast("double"), silent.cast("double")).alias("false_negative_rate"),
        F.try_divide(F.col(TP).cast("double"), fired.cast("double")).alias("precision"),
    )


def sensitivity(replayed: DataFrame, engine: Engine) -> DataFrame:
    """The summary per percentile, with the frozen operating point flagged."""
    return summarise(replayed, ["series_id", "metric", "percentile"]).withColumn(
        "is_frozen_operating_point", F.col("percentile") == engine.warn_percentile
    )


def fired_origins(backtest: DataFrame) -> DataFrame:
    return backtest.filter(F.col("highest_tier").isNotNull()).select(
        "series_id", "metric", "origin_date", "threshold", "highest_tier", "earliest_tier",
        "fired_horizons", "outcome", "lead_time",
    )


def capacity(rows: DataFrame, engine: Engine) -> DataFrame:
    """Qualitative label of ``forecast`` against ``threshold``."""
    return rows.withColumn(
        "capacity_tier", capacity_label(F.col("forecast"), F.col("threshold"), engine.elevated_fraction)
    )
