"""Reporting calendar: spine, alignment, boundaries and forward slots.

A slot's ``pos`` counts reporting slots, never calendar days.  All windows
partition by series; a series holds at most one row per calendar slot, so a
partition is bounded by the length of history and not by the volume of raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine


def by_series(order: str = "pos") -> Window:
    return Window.partitionBy("series_id").orderBy(order)


def on_template(ds: Column, engine: Engine) -> Column:
    return F.weekday(ds).isin(*engine.reporting_weekdays)


def slots_between(first: Column, last: Column, engine: Engine) -> Column:
    step = F.expr(f"interval 1 {engine.slot}")
    return F.explode(F.sequence(first, last, step))


def keep_reporting_slots(obs: DataFrame, engine: Engine) -> DataFrame:
    """Observations on the weekday template or on one of the engine's named days."""
    if len(engine.reporting_weekdays) == 7:
        return obs
    named = F.to_date("ds").isin([F.lit(d).cast("date") for d in engine.off_template_days]) if engine.off_template_days else F.lit(False)
    return obs.filter(on_template(F.col("ds"), engine) | named)


def template_slots(obs: DataFrame, engine: Engine) -> DataFrame:
    """Every template slot from the first to the last observation of each series."""
    return (
        obs.groupBy("series_id")
        .agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
        .select("series_id", slots_between(F.col("first_ds"), F.col("last_ds"), engine).alias("ds"))
        .filter(on_template(F.col("ds"), engine))
    )


def reporting_spine(obs: DataFrame, engine: Engine) -> DataFrame:
    """The template slots together with the off-template slots really reported."""
    named = obs.select("series_id", "ds").filter(~on_template(F.col("ds"), engine))
    return template_slots(obs, engine).unionByName(named)


def align(obs: DataFrame, engine: Engine) -> DataFrame:
    """Observations on the spine: gap slots become explicit, measures NULL there.

    Off-template slots exist only among the observations, so one full outer join
    is both the union with the named days and the reindexing.
    """
    aligned = template_slots(obs, engine).join(
        obs.withColumn("seen", F.lit(True)), ["series_id", "ds"], "full"
    )
    return aligned.select(
        "series_id",
        "ds",
        (F.row_number().over(by_series("ds")) - 1).alias("pos"),
        F.col("seen").isNull().alias("is_imputed"),
        *engine.measure_names,
    )


def slot_label(ds: Column) -> Column:
    """Long date label with a zero-padded day."""
    return F.date_format(ds, "MMMM dd, yyyy")


def series_bounds(master: DataFrame, engine: Engine, cap_date: str | None = None) -> DataFrame:
    """One row per series: size, cutoff position and holdout boundary.

    The cap date is the given one, or the day after ``cap_fraction`` of the
    series' span.  The holdout starts at the n-th *real* slot from the end; its
    boundary is NULL where a series has too few real slots, and such a series
    yields no folds.
    """
    span = F.datediff(F.max("ds").over(_whole()), F.min("ds").over(_whole()))
    cap = (
        F.lit(cap_date).cast("date")
        if cap_date
        else F.date_add(
            F.min("ds").over(_whole()).cast("date"), F.floor(span * engine.cap_fraction).cast("int")
        )
    )
    real = ~F.col("is_imputed")
    # real slots from this one to the end = all - those before; both cheap frames
    before = by_series().rowsBetween(Window.unboundedPreceding, -1)
    rank = F.count_if(real).over(_whole()) - F.count_if(real).over(before)
    ranked = master.select("series_id", "ds", "pos", "is_imputed", cap.alias("cap_date"), rank.alias("rank"))
    return (
        ranked.groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("n_slots"),
            F.min("ds").alias("first_ds"),
            F.max("ds").alias("last_ds"),
            F.first("cap_date").alias("cap_date"),
            F.min(F.when(F.col("ds") >= F.col("cap_date"), F.col("pos"))).alias("cutoff_pos"),
            F.max(F.when(real, F.col("pos"))).alias("last_real_pos"),
            F.max(F.when(real & (F.col("rank") == engine.holdout_real), F.col("pos"))).alias(
                "holdout_start_pos"
            ),
        )
        .withColumn("dev_end_pos", F.col("holdout_start_pos") - 1)
    )


def _whole() -> Window:
    return Window.partitionBy("series_id")


def require_boundaries(bounds: DataFrame) -> DataFrame:
    """Series whose cutoff or holdout could not be placed, with the reason."""
    return bounds.select(
        "series_id",
        F.col("cutoff_pos").isNull().alias("cap_after_series_end"),
        F.col("holdout_start_pos").isNull().alias("too_few_real_slots"),
    )


def forward_calendar(master: DataFrame, engine: Engine, slots: int | None = None) -> DataFrame:
    """Dates of the next positions of every series, skipping non-reporting weekdays."""
    slots = slots or engine.longest_horizon
    # every calendar week holds at least one reporting slot
    reach = 7 * slots + 7
    ends = master.groupBy("series_id").agg(
        F.max("ds").alias("last_ds"), F.max("pos").alias("last_pos")
    )
    unit = F.expr(f"interval 1 {engine.slot}")
    ahead = ends.select(
        "series_id",
        "last_pos",
        F.explode(
            F.slice(
                F.filter(
                    F.sequence(F.col("last_ds") + unit, F.col("last_ds") + F.expr(
                        f"interval {reach} {engine.slot}"), unit),
                    lambda d: F.weekday(d).isin(*engine.reporting_weekdays),
                ),
                1,
                slots,
            )
        ).alias("ds"),
    )
    return ahead.select(
        "series_id",
        (F.col("last_pos") + F.row_number().over(by_series("ds"))).alias("pos"),
        "ds",
        F.row_number().over(by_series("ds")).alias("steps_ahead"),
    )
