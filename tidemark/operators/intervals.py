"""Empirical intervals from out-of-sample residuals, their coverage, and the
forward and holdout forecasts that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.functions.intervals import small_sample_note, wilson
from tidemark.operators.folds import actuals, fold_grid, plain_windows
from tidemark.operators.harness import forecasts

KEY = ["series_id", "metric", "horizon"]
CELL = [*KEY, "model"]
EVIDENCE = "primary_pooled_folds_leave_one_out"


def residual_pool(residual: DataFrame, engine: Engine) -> DataFrame:
    """Residuals an interval may use: post-cutoff origins under the deployed rule."""
    return residual.filter(
        (F.col("window_rule") == engine.selection_rule) & F.col("origin_post_cutoff")
    )


def pool_quantiles(pool: DataFrame, engine: Engine) -> DataFrame:
    """Per cell: pool size and the two residual quantiles."""
    ends = F.array(F.lit(engine.alpha / 2), F.lit(1 - engine.alpha / 2))
    return pool.groupBy(*CELL).agg(
        F.count("residual").alias("n_residuals"), F.percentile("residual", ends).alias("q")
    ).select(*CELL, "n_residuals", F.col("q")[0].alias("q_low"), F.col("q")[1].alias("q_high"))


def with_interval(
    points: DataFrame, quantiles: DataFrame, engine: Engine, floor: float | None = None
) -> DataFrame:
    """Attach the interval to ``point_forecast``; withheld, with a reason, if thin.

    The lower end is clipped at ``floor``; the unclipped value is kept beside it.
    """
    joined = points.join(quantiles, CELL, "left")
    n = F.coalesce(F.col("n_residuals"), F.lit(0).cast("bigint"))
    point = F.col("point_forecast")
    enough = (n >= engine.min_residuals) & point.isNotNull()
    raw = F.when(enough, point + F.col("q_low"))
    upper = F.when(enough, point + F.col("q_high"))
    clipped = F.coalesce(raw < floor, F.lit(False)) if floor is not None else F.lit(False)
    lower = F.when(clipped, F.lit(floor)).otherwise(raw) if floor is not None else raw
    note = (
        F.when(
            n < engine.min_residuals,
            F.format_string("few_residuals:%d", n),
        )
        .when(point.isNull(), F.lit("forecast_missing"))
        .otherwise(F.lit(""))
    )
    return joined.select(
        *points.columns,
        lower.alias("lower"),
        raw.alias("lower_unclipped"),
        clipped.alias("clipped_at_floor"),
        upper.alias("upper"),
        (upper - lower).alias("interval_width"),
        n.alias("n_residuals"),
        enough.alias("interval_sufficient"),
        note.alias("interval_note"),
        F.lit(engine.nominal).alias("nominal_coverage"),
    )


def banded(counts: DataFrame, engine: Engine, level: float = 0.95) -> DataFrame:
    """Coverage with its Wilson band from ``n`` and ``n_covered``."""
    low, high = wilson(F.col("n_covered"), F.col("n"), level)
    return counts.select(
        "*",
        F.try_divide(F.col("n_covered").cast("double"), F.col("n").cast("double")).alias(
            "empirical_coverage"
        ),
        F.lit(engine.nominal).alias("nominal_coverage"),
        low.alias("band_low"),
        high.alias("band_high"),
        F.coalesce(F.lit(engine.nominal).between(low, high), F.lit(False)).alias("covers_nominal"),
        F.when(F.col("n") == 0, F.lit("no_scorable_points"))
        .otherwise(small_sample_note(F.col("n"), engine.small_n))
        .alias("note"),
    )


def coverage(rows: DataFrame, keys: list[str], engine: Engine) -> DataFrame:
    """Coverage of ``[lower, upper]`` over ``y_true`` where all three are present."""
    usable = F.col("y_true").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    counts = rows.groupBy(*keys).agg(
        F.count_if(usable).alias("n"),
        F.count_if(usable & F.col("y_true").between(F.col("lower"), F.col("upper"))).alias("n_covered"),
    )
    return banded(counts, engine)


def leave_one_out_counts(pool: DataFrame, engine: Engine) -> DataFrame:
    """Each residual against the quantiles of the others; pools of three or more.

    In a sorted pool the others of element ``i`` are the same array with one index
    skipped, so both quantiles are direct look-ups and a cell costs one pass.
    """
    cells = pool.groupBy(*CELL).agg(F.array_sort(F.collect_list("residual")).alias("r"))
    n = F.size("r")

    def others(i: Column, q: float) -> Column:
        rank = F.lit(q) * (n - 2)
        k = F.floor(rank).cast("int")
        k2 = F.least(k + 1, n - 2)

        def skip(index: Column) -> Column:
            return F.get("r", index + F.when(index >= i, F.lit(1)).otherwise(F.lit(0)))

        return skip(k) + (skip(k2) - skip(k)) * (rank - k)

    inside = F.transform(
        "r", lambda x, i: x.between(others(i, engine.alpha / 2), others(i, 1 - engine.alpha / 2))
    )
    return cells.filter(n >= 3).select(
        *CELL,
        n.cast("bigint").alias("n"),
        F.size(F.filter(inside, lambda ok: ok)).cast("bigint").alias("n_covered"),
    )


def pooled_coverage(pool: DataFrame, champions: DataFrame, engine: Engine) -> DataFrame:
    """Leave-one-out coverage of every cell's champion."""
    chosen = champions.select(*KEY, F.col("champion").alias("model"))
    counts = leave_one_out_counts(pool.join(chosen, CELL, "left_semi"), engine)
    return banded(counts, engine).withColumn("evidence", F.lit(EVIDENCE))


def candidate_points(
    requests: DataFrame, panel: DataFrame, engine: Engine, models: tuple, pairs: DataFrame | None,
    learned: DataFrame | None = None, stored: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Every candidate's forecast for plain-rule requests, the ensemble included.

    ``learned``: the tree families' forecasts of the same requests, from their stored fits.
    ``stored``: forecasts of statistical families for the windows of the same requests."""
    made = forecasts(requests, panel, engine, models, learned, stored)
    if pairs is None:
        return made
    keyed = made.join(pairs, KEY)
    point = Window.partitionBy(*KEY, "origin_pos")
    second = F.max(F.when(F.col("model") == F.col("second_model"), F.col("y_pred"))).over(point)
    mean = (
        keyed.withColumn("_second", second)
        .filter(F.col("model") == F.col("first_model"))
        .withColumn("y_pred", (F.col("y_pred") + F.col("_second")) / 2)
        .withColumn("model", F.lit("ensemble"))
        .select(*made.columns)
    )
    return made.unionByName(mean)


def forward_requests(
    master: DataFrame, bounds: DataFrame, state: DataFrame, engine: Engine, metrics: tuple | None = None
) -> DataFrame:
    """One request per series, target and horizon from the last real slot."""
    ends = bounds.select(
        "series_id", "cutoff_pos", F.col("last_real_pos").alias("train_cutoff_pos")
    ).join(
        master.select("series_id", F.col("pos").alias("train_cutoff_pos"), F.col("ds").alias("origin_date")),
        ["series_id", "train_cutoff_pos"],
    )
    rows = plain_windows(ends, state).filter(F.col("metric").isin(*(metrics or engine.targets)))
    return rows.select(
        "*",
        F.col("train_cutoff_pos").alias("origin_pos"),
        F.explode(F.array(*[F.lit(h) for h in engine.horizons])).alias("horizon"),
    ).withColumn("effective_lead", F.col("horizon"))


def forward_forecasts(
    points: DataFrame, champions: DataFrame, quantiles: DataFrame, engine: Engine
) -> DataFrame:
    """Every model beyond the last observation, champion flagged, interval attached."""
    flagged = points.join(champions.select(*KEY, "champion"), KEY, "left").select(
        *CELL,
        F.coalesce(F.col("model") == F.col("champion"), F.lit(False)).alias("is_champion"),
        "champion",
        "origin_pos",
        "origin_date",
        (F.col("origin_pos") + F.col("horizon")).alias("forecast_pos"),
        F.col("y_pred").alias("point_forecast"),
        "train_start_pos",
        (F.col("origin_pos") - F.col("train_start_pos") + 1).alias("train_n_positions"),
    )
    return with_interval(flagged, quantiles, engine, floor=0.0)


def plain_requests(folds: DataFrame, state: DataFrame, engine: Engine) -> DataFrame:
    """Fold x horizon x target requests under the rule without a floor."""
    return fold_grid(plain_windows(folds, state)).filter(F.col("metric").isin(*engine.targets))


def holdout_evaluation(
    points: DataFrame, champions: DataFrame, quantiles: DataFrame, panel: DataFrame, engine: Engine
) -> DataFrame:
    """Champions refit at holdout origins, against development intervals, unclipped."""
    chosen = points.join(
        champions.select(*KEY, F.col("champion").alias("model")), CELL
    ).join(actuals(panel).filter("y_true_is_observed"), ["series_id", "metric", "test_pos"])
    rows = chosen.select(
        *CELL, "fold_id", "origin_pos", "origin_date", "test_pos", "test_date", "y_true",
        F.col("y_pred").alias("point_forecast"),
    )
    held = with_interval(rows, quantiles, engine)
    return held.select(
        *KEY, F.col("model").alias("champion"), "fold_id", "origin_pos", "origin_date", "test_pos",
        "test_date", "y_true", "point_forecast", "lower", "upper",
        F.when(
            F.col("interval_sufficient"), F.col("y_true").between(F.col("lower"), F.col("upper"))
        ).alias("covered"),
        F.abs(F.col("y_true") - F.col("point_forecast")).alias("abs_error"),
    )


def holdout_summary(holdout: DataFrame) -> DataFrame:
    return holdout.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("covered").alias("n_covered"),
        F.avg("abs_error").alias("mae"),
        (F.count_if("covered") / F.count(F.lit(1))).alias("coverage"),
    )


def calibration_notes(forward: DataFrame, cover: DataFrame) -> DataFrame:
    """calibrated / not_calibrated / no_evidence for every forward row."""
    known = cover.select(*CELL, "covers_nominal", "empirical_coverage")
    return forward.select(*CELL).join(known, CELL, "left").select(
        *CELL,
        F.when(F.col("covers_nominal").isNull(), F.lit("no_evidence"))
        .when(F.col("covers_nominal"), F.lit("calibrated"))
        .otherwise(F.lit("not_calibrated"))
        .alias("status"),
        "empirical_coverage",
    )


def calibration_failures(cover: DataFrame) -> DataFrame:
    """Cells whose band excludes the nominal level, and their share per metric."""
    return cover.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(~F.col("covers_nominal")).alias("n_failed"),
        F.avg((~F.col("covers_nominal")).cast("double")).alias("share_failed"),
    )
