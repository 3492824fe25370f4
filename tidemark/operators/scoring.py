"""Metrics matrices, gates and diagnostics over the prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import (
    ALL_FOLDS, BASELINES, COMMON, ENSEMBLE, GATE_REFERENCES, LEARNED, RECENT, RECENT_COMMON,
    STATISTICAL, Engine,
)
from tidemark.functions import scores as S
from tidemark.operators.harness import COLUMNS, POINT, scorable

CELL = ["series_id", "metric", "model", "window_rule", "horizon"]


def _y() -> Column:
    return F.col("y_true")


def _f() -> Column:
    return F.col("y_pred")


def interpolated_actual() -> Column:
    return ~F.col("y_true_is_observed") & F.col("y_true").isNotNull()


def _measures(inside: Column, only_observed: bool, folds_once: bool) -> list[Column]:
    """The matrix's columns over the rows ``inside``.

    ``folds_once``: a group holds a fold in one row at most, so folds are counted and need no distinct count.
    """
    seen = inside & F.col("y_true_is_observed") if only_observed else inside
    # an unscored row must not enter n_total either, so it is masked to NULL
    y = F.when(seen, _y())
    f = F.when(seen, _f())
    contaminated = inside & F.col("gap_contaminated")
    folds = [F.count_if(inside), F.count_if(contaminated)] if folds_once else [
        F.count_distinct(F.when(c, F.col("fold_id"))) for c in (inside, contaminated)
    ]
    return [
        F.count_if(S.paired(y, f)).alias("n_scored"),
        F.count_if(seen).alias("n_total"),
        F.count_if(seen & _y().isNull()).alias("n_missing_actual"),
        F.count_if(y.isNotNull() & f.isNull()).alias("n_missing_pred"),
        S.zero_actuals(y, f).alias("n_zero_actual_excluded_from_mape"),
        S.mae(y, f).alias("MAE"),
        S.rmse(y, f).alias("RMSE"),
        S.mape(y, f).alias("MAPE"),
        S.smape(y, f).alias("sMAPE"),
        S.pooled_mase(y, f, F.col("mase_scale")).alias("MASE"),
        S.mean_error(y, f).alias("ME_bias"),
        F.count_if(inside & interpolated_actual()).alias("n_excluded_interpolated_actual"),
        folds[0].alias("n_folds"),
        folds[1].alias("n_gap_contaminated_folds"),
    ]


def metrics_matrix(
    predictions: DataFrame, keys: list[str] = CELL, only_observed: bool = True
) -> DataFrame:
    """All measures per group; interpolated actuals are counted but never scored.

    A prediction table holds a fold once per cell; groups that are coarser than cells count distinct folds.
    """
    return predictions.groupBy(*keys).agg(*_measures(F.lit(True), only_observed, set(CELL) <= set(keys)))


def scoped_metrics(predictions: DataFrame) -> DataFrame:
    """The four overlapping scopes scored in one aggregation; rows are not copied, each scope has its own columns in it."""
    recent, common = F.col("origin_post_cutoff"), F.col("common_support")
    scopes = {ALL_FOLDS: F.lit(True), COMMON: common, RECENT: recent, RECENT_COMMON: recent & common}
    made = predictions.groupBy(*CELL).agg(*[
        F.struct(F.lit(name).alias("fold_scope"), *_measures(inside, True, True)).alias(name) for name, inside in scopes.items()
    ])
    each = made.select(*CELL, F.explode(F.array(*scopes)).alias("m")).filter("m.n_folds > 0")
    return each.select("m.fold_scope", *CELL, *[f"m.{c}" for c in made.schema[ALL_FOLDS].dataType.fieldNames()[1:]])


def pooled_metrics(predictions: DataFrame) -> DataFrame:
    """The matrix across all series of a metric."""
    return metrics_matrix(predictions, ["metric", "model", "window_rule", "horizon"])


def gate(metrics: DataFrame, candidates: tuple, keys: list[str] | None = None) -> DataFrame:
    """A candidate passes a cell by beating the better reference, strictly."""
    keys = keys or ["series_id", "metric", "window_rule", "horizon"]
    cell = Window.partitionBy(*keys)

    def reference(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("MAE"))).over(cell)

    refs = metrics.select(
        *keys, "model", "MAE", *[reference(m).alias(f"MAE_{m}") for m in GATE_REFERENCES]
    )
    # least() skips NULLs, so one present reference is enough
    best = F.least(*[F.col(f"MAE_{m}") for m in GATE_REFERENCES])
    return refs.filter(F.col("model").isin(*candidates) & best.isNotNull()).select(
        *keys,
        "model",
        "MAE",
        *[f"MAE_{m}" for m in GATE_REFERENCES],
        F.coalesce(F.col("MAE") < best, F.lit(False)).alias("beats_both_baselines"),
        F.when(best > 0, (1 - F.col("MAE") / best) * 100).alias("skill_vs_best_baseline_pct"),
    )


def residuals(predictions: DataFrame) -> DataFrame:
    """Out-of-sample residuals of scorable points."""
    keep = [
        "series_id", "metric", "model", "window_rule", "fold_id", "origin_pos", "origin_date",
        "origin_post_cutoff", "horizon", "effective_lead", "test_pos", "test_date", "y_true", "y_pred",
    ]
    return predictions.filter(scorable()).select(
        *keep,
        (_y() - _f()).alias("residual"),
        F.abs(_y() - _f()).alias("abs_residual"),
    )


def residual_counts(residual: DataFrame, engine: Engine) -> DataFrame:
    """Post-cutoff pool sizes with the horizons as columns."""
    return (
        residual.filter("origin_post_cutoff")
        .groupBy("series_id", "metric", "model")
        .agg(*[F.count_if(F.col("horizon") == h).alias(f"n_h{h}") for h in engine.horizons])
    )


def abstentions(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("series_id", "metric", "model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_y().isNull()).alias("actual_missing"),
        F.count_if(interpolated_actual()).alias("actual_interpolated_excluded"),
        F.count_if(_f().isNull()).alias("forecast_abstained"),
    )


def contamination(predictions: DataFrame) -> DataFrame:
    """How far the full-window errors move when gap-adjacent points are dropped."""
    flagged = F.col("row_gap_adjacent")
    clean_y, dirty_y = F.when(~flagged, _y()), F.when(flagged, _y())
    return (
        predictions.filter((F.col("window_rule") == "full") & F.col("y_true_is_observed"))
        .groupBy("series_id", "metric", "model", "horizon")
        .agg(
            S.mae(_y(), _f()).alias("MAE_all_folds"),
            F.count(clean_y).alias("n_clean"),
            S.mae(clean_y, _f()).alias("MAE_clean"),
            F.count(dirty_y).alias("n_flagged"),
            S.mae(dirty_y, _f()).alias("MAE_flagged"),
            S.smape(clean_y, _f()).alias("sMAPE_clean"),
            S.smape(dirty_y, _f()).alias("sMAPE_flagged"),
        )
        .withColumn(
            "MAE_shift_pct_if_dropped",
            F.when(
                F.col("MAE_all_folds") > 0,
                (F.col("MAE_clean") - F.col("MAE_all_folds")) / F.col("MAE_all_folds") * 100,
            ),
        )
    )


def largest_shift(table: DataFrame) -> DataFrame:
    return table.groupBy("series_id", "metric").agg(
        F.max(F.abs("MAE_shift_pct_if_dropped")).alias("max_abs_shift_pct")
    )


def _fits(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("series_id", "metric", "model", "window_rule", "fold_id").agg(
        F.bool_or("fit_failed").alias("fit_failed"),
        F.max("failure_reason").alias("failure_reason"),
    )


def fit_reliability(predictions: DataFrame) -> DataFrame:
    return (
        _fits(predictions)
        .groupBy("metric", "model")
        .agg(
            F.count(F.lit(1)).alias("fits_attempted"),
            F.count_if("fit_failed").alias("fits_failed"),
        )
        .withColumn(
            "success_rate_pct", 100 * (1 - F.col("fits_failed") / F.col("fits_attempted"))
        )
    )


def failure_reasons(predictions: DataFrame) -> DataFrame:
    return (
        _fits(predictions)
        .filter("fit_failed")
        .groupBy("model", "failure_reason")
        .agg(F.count(F.lit(1)).alias("folds"))
    )


def rule_effect(predictions: DataFrame) -> DataFrame:
    """Forecasts under both window rules, paired on the same point."""
    paired = (
        predictions.groupBy("series_id", "metric", "model", "fold_id", "horizon")
        .agg(
            F.max(F.when(F.col("window_rule") == "full", _f())).alias("full"),
            F.max(F.when(F.col("window_rule") == "capped", _f())).alias("capped"),
        )
        .filter(F.col("full").isNotNull() & F.col("capped").isNotNull())
        .select("series_id", "metric", "model", F.abs(F.col("full") - F.col("capped")).alias("gap"))
    )
    return paired.groupBy("series_id", "metric", "model").agg(
        F.count(F.lit(1)).alias("comparable_rows"),
        F.count_if(F.col("gap") == 0).alias("identical"),
        F.count_if(F.col("gap") > 0).alias("differing"),
        F.percentile("gap", F.lit(0.5)).alias("median_abs_diff"),
        F.max("gap").alias("max_abs_diff"),
    )


def native_coverage(predictions: DataFrame, engine: Engine) -> DataFrame:
    """Coverage and width of the models' own intervals, full window only."""
    usable = (
        (F.col("window_rule") == "full") & F.col("y_pred_lo").isNotNull()
        & F.col("y_true_is_observed") & F.col("y_true").isNotNull()
    )
    covered = _y().between(F.col("y_pred_lo"), F.col("y_pred_hi"))
    return (
        predictions.filter(usable)
        .groupBy("series_id", "metric", "model", "horizon")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.avg(covered.cast("double")) * 100).alias("empirical_coverage_pct"),
            F.percentile(F.col("y_pred_hi") - F.col("y_pred_lo"), F.lit(0.5)).alias("median_width"),
            F.lit(engine.nominal * 100).alias("nominal_pct"),
        )
    )


def cap_summary(predictions: DataFrame) -> DataFrame:
    """Post-cutoff folds of the capped rule: fell back, genuinely capped, would flip."""
    folds = F.col("fold_id")
    table = (
        predictions.filter((F.col("window_rule") == "capped") & F.col("origin_post_cutoff"))
        .groupBy("series_id", "metric")
        .agg(
            F.count_distinct(folds).alias("post_cutoff_folds"),
            F.count_distinct(F.when(F.col("fallback_applied"), folds)).alias("fell_back"),
            F.count_distinct(F.when(F.col("flips_at_upper_floor"), folds)).alias("would_flip"),
        )
    )
    return table.withColumn("genuinely_capped", F.col("post_cutoff_folds") - F.col("fell_back"))


def support_points(predictions: DataFrame) -> DataFrame:
    """The points every model of an existing comparison was scored on."""
    return predictions.filter("common_support").select(*POINT).distinct()


def complete_matrix(predictions: DataFrame, ensemble: DataFrame) -> DataFrame:
    """An existing comparison, untouched, plus a late model scored on its support."""
    supported = ensemble.select(*COLUMNS).join(
        support_points(predictions).withColumn("supported", F.lit(True)), POINT, "left"
    )
    late = supported.withColumn("common_support", F.col("supported").isNotNull()).drop("supported")
    return scoped_metrics(predictions).unionByName(scoped_metrics(late))


def target_diagnostics(predictions: DataFrame) -> DataFrame:
    """Zero and small actuals, which make percentage errors unstable."""
    y = F.when(F.col("y_true_is_observed"), _y())
    return predictions.groupBy("series_id", "metric").agg(
        F.count_if(y == 0).alias("zero_actuals"),
        F.min(y).alias("min_actual"),
        (F.avg((y < 10).cast("double")) * 100).alias("pct_below_10"),
    )


def family(model: Column) -> Column:
    return (
        F.when(model.isin(*BASELINES), F.lit("baseline"))
        .when(model.isin(*STATISTICAL), F.lit("statistical"))
        .when(model.isin(*LEARNED), F.lit("machine learning"))
        .otherwise(F.lit(ENSEMBLE))
    )


def worst_models(metrics: DataFrame) -> DataFrame:
    """How often each model is the worst of its cell (first name on a tie)."""
    cell = ["series_id", "metric", "horizon"]
    worst = metrics.filter(F.col("MAE").isNotNull()).groupBy(*cell).agg(
        F.min_by("model", F.struct(-F.col("MAE"), F.col("model"))).alias("model")
    )
    return worst.groupBy("metric", "model").agg(F.count(F.lit(1)).alias("cells_worst"))


def comparison_view(metrics: DataFrame) -> DataFrame:
    """One cell as a reader sees it: family, rank, and a gate flag blank for baselines."""
    cell = Window.partitionBy("series_id", "metric", "window_rule", "horizon")
    best = F.min(F.when(F.col("model").isin(*GATE_REFERENCES), F.col("MAE"))).over(cell)
    return metrics.select(
        "series_id", "metric", "window_rule", "horizon", "model",
        family(F.col("model")).alias("family"),
        "n_scored", "MAE", "RMSE", "MAPE", "sMAPE", "MASE", "ME_bias",
        F.when(~F.col("model").isin(*BASELINES), F.coalesce(F.col("MAE") < best, F.lit(False))).alias(
            "beats_both_baselines"
        ),
        F.row_number().over(cell.orderBy(F.col("MAE").asc_nulls_last(), "model")).alias("rank"),
    )


def wins_by_family(champions: DataFrame) -> DataFrame:
    return (
        champions.filter(F.col("champion").isNotNull())
        .groupBy("metric", family(F.col("champion")).alias("family"))
        .agg(F.count(F.lit(1)).alias("wins"))
    )


def family_winners(metrics: DataFrame, members: tuple, engine: Engine, name: str) -> DataFrame:
    """The family's lowest-MAE model per cell on the governing scope and rule."""
    order = Window.partitionBy("series_id", "metric", "horizon").orderBy("MAE", "model")
    return (
        metrics.filter(
            (F.col("fold_scope") == engine.selection_scope)
            & (F.col("window_rule") == engine.selection_rule)
            & F.col("model").isin(*members)
            & F.col("MAE").isNotNull()
        )
        .select("series_id", "metric", "horizon", "model", F.row_number().over(order).alias("rn"))
        .filter("rn = 1")
        .select("series_id", "metric", "horizon", F.col("model").alias(name))
    )


def ensemble_pairs(metrics: DataFrame, engine: Engine) -> DataFrame:
    first = family_winners(metrics, engine.ensemble_first, engine, "first_model")
    second = family_winners(metrics, engine.ensemble_second, engine, "second_model")
    return first.join(second, ["series_id", "metric", "horizon"])


def origin_overlap(predictions: DataFrame) -> DataFrame:
    """Share of test positions forecast from more than one origin."""
    per_position = predictions.groupBy("series_id", "metric", "test_pos").agg(
        F.count_distinct("origin_pos").alias("origins")
    )
    return per_position.groupBy("series_id", "metric").agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.count_if(F.col("origins") > 1).alias("n_shared"),
        F.avg((F.col("origins") > 1).cast("double")).alias("share_shared"),
    )
