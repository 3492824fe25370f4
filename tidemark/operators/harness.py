"""One tidy prediction table from any set of forecasters over the same folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import BASELINES, COMPLEXITY_ORDER, ENSEMBLE, LEARNED, Engine
from tidemark.operators.baselines import baseline_forecasts
from tidemark.operators.folds import actuals, fold_grid, training_windows
from tidemark.operators.smoothing import smoothing_forecasts
from tidemark.operators.statistical import arima_fits, attach

POINT = ["series_id", "metric", "window_rule", "fold_id", "horizon"]
# what a statistical forecast depends on
FITTED_BY = ["series_id", "metric", "train_start_pos", "train_cutoff_pos", "effective_lead"]

COLUMNS = [
    "series_id", "metric", "model", "window_rule", "fold_id", "origin_pos", "origin_date",
    "origin_post_cutoff", "horizon", "effective_lead", "test_pos", "test_date", "y_true",
    "y_true_is_observed", "y_pred", "train_start_pos", "train_cutoff_pos", "train_n_positions",
    "train_n_usable", "fallback_applied", "flips_at_upper_floor", "y_pred_lo", "y_pred_hi",
    "fit_failed", "failure_reason", "mase_scale", "origin_is_imputed", "origin_adjacent_to_gap",
    "test_is_imputed", "test_adjacent_to_gap", "gap_contaminated", "row_gap_adjacent",
]


def check_models(models: tuple) -> None:
    known = set(COMPLEXITY_ORDER) - {ENSEMBLE}
    unknown = set(models) - known
    if unknown:
        raise ValueError(f"unknown model {sorted(unknown)}; expected some of {sorted(known)}")


def requests(folds: DataFrame, state: DataFrame, panel: DataFrame, engine: Engine) -> DataFrame:
    """Fold x horizon x rule x metric rows with their training state and actual.

    The actual is joined here, once per point, and not once per model.
    """
    rows = fold_grid(training_windows(folds, state, engine))
    return rows.join(actuals(panel), ["series_id", "metric", "test_pos"]).withColumn(
        "row_gap_adjacent",
        F.col("origin_is_imputed")
        | F.col("origin_adjacent_to_gap")
        | F.col("test_is_imputed")
        | F.col("test_adjacent_to_gap"),
    )


def forecasts(
    rows: DataFrame, panel: DataFrame, engine: Engine, models: tuple, learned: DataFrame | None = None,
    stored: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Every model's forecast for every row; failures are NULL with a reason.

    ``stored``: forecasts of statistical families that hold all windows of ``rows``; families without are fitted.
    """
    check_models(models)
    stored = stored or {}
    parts = []
    plain = tuple(m for m in models if m in BASELINES)
    if plain:
        made = baseline_forecasts(rows, engine, plain)
        parts.append(
            made.select(
                "*",
                F.lit(None).cast("double").alias("y_pred_lo"),
                F.lit(None).cast("double").alias("y_pred_hi"),
                F.lit(False).alias("fit_failed"),
                F.lit(False).alias("forecast_failed"),
                F.lit("").alias("failure_reason"),
            )
        )
    for model in (m for m in ("exponential_smoothing", "sarima") if m in models):
        fits = stored[model] if model in stored else statistical_fits(rows, panel, engine, model)
        parts.append(attach(rows, fits, model))
    if any(m in LEARNED for m in models):
        if learned is None:
            raise ValueError("tree families are forecast from stored fits; pass their forecasts as learned")
        parts.append(learned.filter(F.col("model").isin(*models)))
    columns = parts[0].columns
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def statistical_fits(
    rows: DataFrame, panel: DataFrame, engine: Engine, model: str, stored: DataFrame | None = None
) -> DataFrame:
    """Forecasts of one statistical family by training window and lead, taken from ``stored`` where it holds them.

    A forecast depends on its window and lead alone, so a window that was fitted is not fitted again.
    """
    made, specs = (smoothing_forecasts, engine.smoothing) if model == "exponential_smoothing" else (arima_fits, engine.arima)
    if stored is None:
        return made(panel, rows, specs, engine)
    asked = rows.filter(F.col("metric").isin(*specs)).select(*FITTED_BY).distinct()
    known = stored.join(asked, FITTED_BY, "left_semi").select(*stored.columns)
    fresh = made(panel, asked.join(stored.select(*FITTED_BY), FITTED_BY, "left_anti"), specs, engine)
    return known.unionByName(fresh.select(*stored.columns))


def walk_forward(
    folds: DataFrame,
    state: DataFrame,
    panel: DataFrame,
    engine: Engine,
    models: tuple = BASELINES,
    learned: DataFrame | None = None,
) -> DataFrame:
    """The tidy prediction table: one row per (series, metric, model, rule, fold, horizon)."""
    rows = requests(folds, state, panel, engine)
    return forecasts(rows, panel, engine, models, learned).select(*COLUMNS)


def scorable() -> Column:
    return (
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull() & F.col("y_true_is_observed")
    )


def with_common_support(predictions: DataFrame, keys: list[str] = POINT) -> DataFrame:
    """Flag points on which *every* model can be scored."""
    every = F.bool_and(scorable()).over(Window.partitionBy(*keys))
    return predictions.withColumn("common_support", every)


def ensemble_forecasts(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean of the two family winners on points that exist for both.

    ``pairs``: ``series_id, metric, horizon, first_model, second_model``.  The mean
    is NULL where either side abstained.  Both sides sit on the same point, so
    one conditional aggregate per point replaces a self-join.
    """
    keyed = predictions.join(pairs, ["series_id", "metric", "horizon"]).filter(
        (F.col("model") == F.col("first_model")) | (F.col("model") == F.col("second_model"))
    )
    point = Window.partitionBy(*POINT)
    second = F.max(F.when(F.col("model") == F.col("second_model"), F.col("y_pred"))).over(point)
    present = F.count_if(F.col("model") == F.col("second_model")).over(point)
    return (
        keyed.select("*", second.alias("_second"), present.alias("_present"))
        .filter((F.col("model") == F.col("first_model")) & (F.col("_present") > 0))
        .select(
            *[
                {
                    "model": F.lit(ENSEMBLE).alias("model"),
                    "y_pred": ((F.col("y_pred") + F.col("_second")) / 2).alias("y_pred"),
                    "y_pred_lo": F.lit(None).cast("double").alias("y_pred_lo"),
                    "y_pred_hi": F.lit(None).cast("double").alias("y_pred_hi"),
                }.get(c, F.col(c))
                for c in COLUMNS
            ],
            F.concat_ws(" + ", "first_model", "second_model").alias("ensemble_components"),
        )
    )


def stack(*tables: DataFrame) -> DataFrame:
    """Prediction tables of several runs as one, in the shared column order."""
    return reduce(DataFrame.unionByName, [t.select(*COLUMNS) for t in tables])
