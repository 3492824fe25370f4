"""Inflow against outflow: component residuals, their correlation, the net signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.functions.intervals import difference_variance
from tidemark.functions.scores import correlation
from tidemark.operators.scoring import residuals

# Status codes of the sign.
INFLOW_EXCEEDS = "inflow_exceeds"
OUTFLOW_EXCEEDS = "outflow_exceeds"


def component_residuals(predictions: DataFrame, engine: Engine, recent_only: bool = True) -> DataFrame:
    """Residuals of the component series under its baseline treatment."""
    kept = residuals(predictions).filter(
        (F.col("metric") == engine.inflow) & F.col("model").isin(*engine.component_models)
    )
    if recent_only:
        kept = kept.filter(
            F.col("origin_post_cutoff") & (F.col("window_rule") == engine.selection_rule)
        )
    return kept


def _paired(component: DataFrame, target: DataFrame) -> DataFrame:
    keys = ["series_id", "window_rule", "fold_id", "horizon"]
    left = component.select(*keys, F.col("model").alias("component_model"), F.col("residual").alias("a"))
    right = target.select(*keys, F.col("model").alias("target_model"), F.col("residual").alias("b"))
    return left.join(right, keys)


def _moments() -> list:
    return [
        F.count(F.lit(1)).alias("n_paired"),
        correlation(F.col("a"), F.col("b")).alias("correlation"),
        F.covar_samp("a", "b").alias("covariance"),
        F.var_samp("a").alias("var_component"),
        F.var_samp("b").alias("var_target"),
    ]


def residual_correlation(component: DataFrame, target: DataFrame, engine: Engine) -> DataFrame:
    """Component model x target model: moments of paired residuals, all folds."""
    pairs = _paired(component, target)
    grid = pairs.groupBy("series_id", "component_model", "target_model").agg(*_moments())
    return grid.filter("n_paired >= 3").withColumn(
        "independence_admissible",
        F.coalesce(F.abs("correlation") < engine.independence_limit, F.lit(False)),
    )


def component_stats(component: DataFrame, target: DataFrame) -> DataFrame:
    """The same moments per horizon, NULL below three pairs; the covariance is then 0."""
    table = _paired(component, target).groupBy(
        "series_id", "component_model", "target_model", "horizon"
    ).agg(*_moments())
    enough = F.col("n_paired") >= 3
    return table.select(
        "series_id", "component_model", "target_model", "horizon", "n_paired",
        *[F.when(enough, F.col(c)).alias(c) for c in ("var_component", "var_target", "correlation")],
        F.when(enough, F.col("covariance")).otherwise(F.lit(0.0)).alias("covariance"),
    )


def imbalance_forecast(
    points: DataFrame, champions: DataFrame, component: DataFrame, target: DataFrame, engine: Engine
) -> DataFrame:
    """Component forecast minus champion forecast with its standard deviation.

    ``points`` carries forward forecasts of the inflow and of the outflow.
    """
    inflow = points.filter(
        (F.col("metric") == engine.inflow) & (F.col("model") == engine.component_models[0])
    ).select(
        "series_id", "horizon", "origin_date",
        F.col("model").alias("component_model"), F.col("y_pred").alias("component_forecast"),
    )
    outflow = (
        points.filter(F.col("metric") == engine.outflow)
        .join(
            champions.select("series_id", "metric", "horizon", F.col("champion").alias("model")),
            ["series_id", "metric", "horizon", "model"],
        )
        .select(
            "series_id", "horizon", F.col("model").alias("target_model"),
            F.col("y_pred").alias("target_forecast"),
        )
    )
    stats = component_stats(component, target)
    joined = inflow.join(outflow, ["series_id", "horizon"]).join(
        stats, ["series_id", "horizon", "component_model", "target_model"], "left"
    )
    variance, form = difference_variance(
        F.col("var_component"), F.col("var_target"), F.coalesce(F.col("covariance"), F.lit(0.0)),
        F.col("correlation"), engine.independence_limit,
    )
    net = F.col("component_forecast") - F.col("target_forecast")
    std = F.sqrt(variance)
    return joined.select(
        "series_id", "horizon", "origin_date", "component_model", "component_forecast",
        "target_model", "target_forecast", net.alias("net_pressure"), variance.alias("variance"),
        std.alias("std"), (net - std).alias("lower_1sd"), (net + std).alias("upper_1sd"),
        form.alias("uncertainty_form"), F.col("correlation").alias("measured_correlation"),
        F.coalesce("n_paired", F.lit(0).cast("bigint")).alias("n_paired_residuals"),
        "var_component", "var_target",
        F.when(net > 0, F.lit(INFLOW_EXCEEDS)).otherwise(F.lit(OUTFLOW_EXCEEDS)).alias("interpretation"),
    )


def imbalance_summary(forecast: DataFrame) -> DataFrame:
    """The horizon of the largest absolute pressure and the range of the spread."""
    top = F.max_by(
        F.struct("horizon", "net_pressure"),
        F.struct(F.round(F.abs("net_pressure"), 9), -F.col("horizon")),
    )
    return forecast.filter(F.col("net_pressure").isNotNull()).groupBy("series_id").agg(
        top.alias("top"), F.min("std").alias("min_std"), F.max("std").alias("max_std")
    ).select(
        "series_id", F.col("top.horizon").alias("worst_horizon"),
        F.col("top.net_pressure").alias("worst_net_pressure"), "min_std", "max_std",
    )


def net_flow(master: DataFrame, engine: Engine) -> DataFrame:
    """Inflow minus outflow per slot; NULL where either is missing."""
    return master.select(
        "series_id", "ds", "pos", (F.col(engine.inflow) - F.col(engine.outflow)).alias("net_flow")
    )


def tail(rows: DataFrame, n: int, upto: DataFrame | None = None) -> DataFrame:
    """The last ``n`` slots of every series, or the last ``n`` up to its origin."""
    if upto is not None:
        return rows.join(upto.select("series_id", "origin_pos"), "series_id").filter(
            F.col("pos").between(F.col("origin_pos") - n + 1, F.col("origin_pos"))
        )
    last = F.max("pos").over(Window.partitionBy("series_id"))
    return rows.withColumn("_last", last).filter(F.col("pos") > F.col("_last") - n).drop("_last")


