"""Lags, trailing statistics, calendar markers and the design matrix.

All lag and rolling columns of a series share one window ordering, so the whole
feature table costs a single shuffle and a single sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.functions.holidays import holidays
from tidemark.operators.calendar import by_series
from tidemark.operators.cleaning import by_metric

CALENDAR = ("day_of_week", "month", "is_near_holiday")


def feature_sources(engine: Engine) -> tuple:
    return (*engine.measure_names, "net_flow")


def lag_and_rolling(master: DataFrame, engine: Engine) -> DataFrame:
    """Net flow, lags, and trailing mean/variance/count.

    A rolling frame ends one slot before the current row, so no row can enter its
    own statistic; missing slots are skipped and counted by ``nobs``.
    """
    w = by_series()
    base = master.withColumn("net_flow", F.col(engine.inflow) - F.col(engine.outflow))
    new: list[Column] = []
    for c in feature_sources(engine):
        value = F.col(c).cast("double")
        new += [F.lag(value, k).over(w).alias(f"lag_{k}_{c}") for k in engine.lags]
        for k in engine.windows:
            frame = w.rowsBetween(-k, -1)
            new += [
                F.avg(value).over(frame).alias(f"rolling_{k}_mean_{c}"),
                F.var_samp(value).over(frame).alias(f"rolling_{k}_var_{c}"),
                F.count(value).over(frame).cast("double").alias(f"rolling_{k}_nobs_{c}"),
            ]
    return base.select("*", *new)


def near_holiday_days(master: DataFrame, engine: Engine) -> DataFrame:
    """Distinct days within reach of a holiday, over the years of the data.

    At most (2 reach + 1) days per holiday: some sixty rows per calendar year.
    """
    r = engine.holiday_reach_days
    span = master.agg(F.min(F.year("ds")).alias("a"), F.max(F.year("ds")).alias("b"))
    years = span.select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("year"))
    return (
        holidays(years)
        .select(F.explode(F.sequence(F.date_sub("ds", r), F.date_add("ds", r))).alias("day"))
        .distinct()
    )


def calendar_features(master: DataFrame, engine: Engine) -> DataFrame:
    """Weekday (Monday 0), month, and whether a holiday lies within two calendar days.

    The band around a holiday is unfolded into single days first, so closeness is
    an equi-join with a table of known size.
    """
    near = F.broadcast(near_holiday_days(master, engine).withColumn("near", F.lit(1)))
    day = F.col("ds").cast("date")
    return master.join(near, day == F.col("day"), "left").select(
        *master.columns,
        F.weekday("ds").alias("day_of_week"),
        F.month("ds").alias("month"),
        F.coalesce("near", F.lit(0)).alias("is_near_holiday"),
    )


def feature_table(master: DataFrame, engine: Engine) -> DataFrame:
    return lag_and_rolling(calendar_features(master, engine), engine)


def feature_columns(features: DataFrame) -> list[str]:
    """Predictors: lags, rolling statistics and calendar markers; never a same-slot value."""
    return [
        c for c in features.columns if c.startswith(("lag_", "rolling_")) or c in CALENDAR
    ]


def incomplete_rows(features: DataFrame, engine: Engine) -> DataFrame:
    """Slots past the longest lag that still miss a predictor."""
    missing = F.lit(False)
    for c in feature_columns(features):
        missing = missing | F.col(c).isNull()
    late = F.col("pos") >= max(engine.lags)
    return features.groupBy("series_id").agg(
        F.count_if(late).alias("n_rows"), F.count_if(late & missing).alias("n_incomplete")
    )


def differences(panel: DataFrame) -> DataFrame:
    """First difference over consecutive present observations."""
    present = panel.filter(F.col("value").isNotNull())
    return present.select(
        "series_id", "metric", "pos", "ds", "is_imputed", "value",
        (F.col("value") - F.lag("value").over(by_metric())).alias("diff"),
    )


def centred_mean(panel: DataFrame, width: int = 30) -> DataFrame:
    """Centred rolling mean, only where the whole window lies inside the series."""
    frame = by_metric().rowsBetween(-(width // 2), width - width // 2 - 1)
    value = F.col("value")
    return panel.select(
        "series_id", "metric", "pos",
        F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)).alias("centred_mean"),
    )


def detrended(panel: DataFrame, width: int = 30) -> DataFrame:
    """Value minus its trailing mean, the current row included."""
    frame = by_metric().rowsBetween(-(width - 1), Window.currentRow)
    return panel.filter(F.col("value").isNotNull()).select(
        "series_id", "metric", "pos", (F.col("value") - F.avg("value").over(frame)).alias("detrended")
    )


def training_pairs(
    features: DataFrame, panel: DataFrame, windows: DataFrame, lead: str, complete_only: bool
) -> DataFrame:
    """Counts of (predictors at t, value at t + lead) pairs for every window.

    A label never lies beyond the training cutoff.  ``windows`` carries
    ``series_id, metric, train_start_pos, train_cutoff_pos`` and the lead column.
    Usable pairs are counted once per series and lead as a running total, so each
    window is the difference of two look-ups instead of a scan of its rows.
    """
    missing = F.lit(False)
    for c in feature_columns(features):
        missing = missing | F.col(c).isNull()
    complete = features.select("series_id", F.col("pos").alias("t"), (~missing).alias("complete"))
    leads = windows.select("series_id", "metric", F.col(lead).alias("k")).distinct()
    labelled = (
        panel.join(leads, ["series_id", "metric"])
        .select("series_id", "metric", "k", (F.col("pos") - F.col("k")).alias("t"), F.col("value").alias("label"))
        .filter("t >= 0")
        .join(complete, ["series_id", "t"])
    )
    usable = F.col("label").isNotNull() & (F.col("complete") if complete_only else F.lit(True))
    so_far = (
        Window.partitionBy("series_id", "metric", "k").orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = labelled.select("series_id", "metric", "k", "t", F.count_if(usable).over(so_far).alias("upto"))
    asked = windows.select(
        "*", F.col(lead).alias("k"),
        (F.col("train_cutoff_pos") - F.col(lead)).alias("t_last"),
        (F.col("train_start_pos") - 1).alias("t_before"),
    )
    at_end = totals.select("series_id", "metric", "k", F.col("t").alias("t_last"), F.col("upto").alias("a"))
    at_start = totals.select("series_id", "metric", "k", F.col("t").alias("t_before"), F.col("upto").alias("b"))
    zero = F.lit(0).cast("bigint")
    found = asked.join(at_end, ["series_id", "metric", "k", "t_last"], "left").join(
        at_start, ["series_id", "metric", "k", "t_before"], "left"
    )
    candidates = F.greatest((F.col("t_last") - F.col("t_before")).cast("bigint"), zero)
    pairs = F.when(candidates > 0, F.coalesce("a", zero) - F.coalesce("b", zero)).otherwise(zero)
    return found.select(
        *windows.columns,
        candidates.alias("n_candidates"),
        pairs.alias("n_pairs"),
        (candidates - pairs).alias("n_dropped"),
    )
