"""Rolling-origin folds, training windows and the state a forecaster may see.

Everything a fold needs is read off windows over its own series: the last real
slot at or before the origin is a running maximum, and what lies ``h`` slots
ahead is a ``lead``.  No range join and no cross join of folds with positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.operators.calendar import by_series
from tidemark.operators.cleaning import by_metric


def running(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def gap_adjacent(window: Window) -> Column:
    """The previous or the next slot is a gap."""
    gap = F.col("is_imputed")
    return F.coalesce(F.lag(gap, 1).over(window), F.lit(False)) | F.coalesce(
        F.lead(gap, 1).over(window), F.lit(False)
    )


def gap_flags(master: DataFrame) -> DataFrame:
    """Per slot: itself a gap, and whether a neighbour is one."""
    return master.select(
        "series_id", "ds", "pos", "is_imputed", gap_adjacent(by_series()).alias("adjacent_to_gap")
    )


def training_cutoff(master: DataFrame) -> DataFrame:
    """As-of: the last real slot at or before every slot."""
    last_real = F.max(F.when(~F.col("is_imputed"), F.col("pos"))).over(running(by_series()))
    return master.select("series_id", "pos", last_real.alias("train_cutoff_pos"))


def origin_folds(
    master: DataFrame, bounds: DataFrame, engine: Engine, portion: str = "development"
) -> DataFrame:
    """One row per series and fold, horizons side by side in a struct array.

    ``development`` keeps folds whose longest horizon ends before the holdout;
    ``holdout`` runs the same grid to the end of the series and keeps folds whose
    every test slot lies inside the holdout.
    """
    w = by_series()
    adjacent = gap_adjacent(w)
    flagged = master.select(
        "series_id",
        "ds",
        "pos",
        "is_imputed",
        adjacent.alias("adjacent"),
        F.max(F.when(~F.col("is_imputed"), F.col("pos"))).over(running(w)).alias("train_cutoff_pos"),
    )
    ahead = F.struct("ds", "is_imputed", "adjacent")
    tests = flagged.select(
        "*", *[F.lead(ahead, h).over(w).alias(f"_t{h}") for h in engine.horizons]
    ).filter(
        (F.col("pos") >= engine.first_origin_history - 1)
        & ((F.col("pos") - (engine.first_origin_history - 1)) % engine.fold_step == 0)
    )
    near = min(engine.horizons)
    folds = tests.join(
        bounds.select("series_id", "n_slots", "cutoff_pos", "holdout_start_pos", "dev_end_pos"),
        "series_id",
    )
    if portion == "development":
        inside = F.col("pos") + engine.longest_horizon <= F.col("dev_end_pos")
    elif portion == "holdout":
        inside = (F.col("pos") + engine.longest_horizon <= F.col("n_slots") - 1) & (
            F.col("pos") + near >= F.col("holdout_start_pos")
        )
    else:
        raise ValueError(f"unknown portion {portion!r}")
    return folds.filter(inside).select(
        "series_id",
        F.floor((F.col("pos") - (engine.first_origin_history - 1)) / engine.fold_step)
        .cast("int")
        .alias("fold_id"),
        F.col("pos").alias("origin_pos"),
        F.col("ds").alias("origin_date"),
        "train_cutoff_pos",
        "cutoff_pos",
        F.col("is_imputed").alias("origin_is_imputed"),
        F.col("adjacent").alias("origin_adjacent_to_gap"),
        (F.col("is_imputed") | F.col("adjacent") | F.col(f"_t{near}.is_imputed")).alias(
            "gap_contaminated"
        ),
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon"),
                    (F.col("pos") + h).alias("test_pos"),
                    (F.col("pos") + h - F.col("train_cutoff_pos")).alias("effective_lead"),
                    F.col(f"_t{h}.ds").alias("test_date"),
                    F.col(f"_t{h}.is_imputed").alias("test_is_imputed"),
                    F.col(f"_t{h}.adjacent").alias("test_adjacent_to_gap"),
                )
                for h in engine.horizons
            ]
        ).alias("tests"),
    )


def fold_grid(folds: DataFrame) -> DataFrame:
    """Folds in long form: one row per (series, fold, horizon)."""
    keep = [c for c in folds.columns if c != "tests"]
    return folds.select(*keep, F.inline("tests"))


def fold_manifest(folds: DataFrame, engine: Engine) -> DataFrame:
    """Folds with the horizons as columns."""
    t = F.col("tests")

    def spread(field: str) -> list[Column]:
        return [F.get(t, F.lit(i))[field].alias(f"{field}_h{h}") for i, h in enumerate(engine.horizons)]

    return folds.select(
        "series_id",
        "fold_id",
        "origin_pos",
        "origin_date",
        "train_cutoff_pos",
        *spread("test_pos"),
        *spread("effective_lead"),
        "origin_is_imputed",
        "origin_adjacent_to_gap",
        *spread("test_is_imputed"),
        "gap_contaminated",
    )


def leakage_checks(folds: DataFrame, bounds: DataFrame, master: DataFrame) -> DataFrame:
    """``check, n_folds, n_violations, passed``: each must hold for every fold."""
    real = master.select(
        "series_id", F.col("pos").alias("train_cutoff_pos"), F.col("is_imputed").alias("cutoff_is_gap")
    )
    joined = (
        folds.join(bounds.select("series_id", "dev_end_pos"), "series_id")
        .join(real, ["series_id", "train_cutoff_pos"], "left")
        .select(
            "*",
            F.array_min(F.col("tests.test_pos")).alias("first_test"),
            F.array_max(F.col("tests.test_pos")).alias("last_test"),
        )
    )
    rules = {
        "origin_before_tests": F.col("origin_pos") < F.col("first_test"),
        "tests_before_holdout": F.col("last_test") <= F.col("dev_end_pos"),
        "cutoff_not_after_origin": F.col("train_cutoff_pos") <= F.col("origin_pos"),
        "cutoff_is_real": ~F.col("cutoff_is_gap"),
    }
    counts = joined.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()],
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_violations")) for n in rules]
    )
    return counts.select("n_folds", F.inline(rows)).select(
        "check", "n_folds", "n_violations", (F.col("n_violations") == 0).alias("passed")
    )


def training_state(panel: DataFrame, bounds: DataFrame, engine: Engine) -> DataFrame:
    """What is known at every slot when training ends there.

    ``recent`` holds the last slots' values, newest first; ``last_seen`` the last
    present value with its slot; the counts and the error scale are running
    aggregates, so a training window is two lookups and never a scan.
    """
    w = by_metric()
    so_far = running(w)
    value = F.col("value")
    reach = max(engine.season, engine.average_window)
    jump = F.abs(value - F.lag(value, engine.season).over(w))
    stepped = panel.join(bounds.select("series_id", "cutoff_pos"), "series_id").select(
        "series_id", "metric", "pos", "value", "is_imputed", "cutoff_pos", jump.alias("jump")
    )
    return stepped.select(
        "series_id",
        "metric",
        F.col("pos").alias("train_cutoff_pos"),
        F.last(
            F.when(value.isNotNull(), F.struct(F.col("pos").alias("pos"), value.alias("value"))),
            ignorenulls=True,
        )
        .over(so_far)
        .alias("last_seen"),
        F.array(*[F.lag(value, k).over(w) for k in range(reach)]).alias("recent"),
        F.count(value).over(so_far).alias("usable_from_start"),
        F.count_if(value.isNotNull() & (F.col("pos") >= F.col("cutoff_pos")))
        .over(so_far)
        .alias("usable_from_cap"),
        F.nullif(F.avg("jump").over(so_far), F.lit(0.0)).alias("mase_scale"),
    )


def training_windows(folds: DataFrame, state: DataFrame, engine: Engine) -> DataFrame:
    """Folds x metrics x window rules with the resolved training slice.

    ``capped`` starts at the cutoff only for origins on or after it, and falls
    back to the whole history below ``usable_floor`` usable rows; whether the
    decision would flip at ``usable_ceiling`` is recorded.
    """
    unknown = set(engine.rules) - {"full", "capped"}
    if unknown:
        raise ValueError(f"unknown window rule {sorted(unknown)}; expected full or capped")
    joined = folds.join(state, ["series_id", "train_cutoff_pos"]).withColumn(
        "window_rule", F.explode(F.array(*[F.lit(r) for r in engine.rules]))
    )
    at_cap = (F.col("window_rule") == "capped") & (F.col("origin_pos") >= F.col("cutoff_pos"))
    usable = F.col("usable_from_cap")
    short = F.coalesce(at_cap & (usable < engine.usable_floor), F.lit(False))
    capped = F.coalesce(at_cap & (usable >= engine.usable_floor), F.lit(False))
    start = F.when(capped, F.col("cutoff_pos")).otherwise(F.lit(0))
    return joined.select(
        *[c for c in joined.columns if c not in ("usable_from_start", "usable_from_cap")],
        start.alias("train_start_pos"),
        (F.col("train_cutoff_pos") - start + 1).alias("train_n_positions"),
        F.when(capped, usable).otherwise(F.col("usable_from_start")).alias("train_n_usable"),
        short.alias("fallback_applied"),
        (capped & (usable < engine.usable_ceiling)).alias("flips_at_upper_floor"),
        F.coalesce(F.col("origin_pos") >= F.col("cutoff_pos"), F.lit(False)).alias(
            "origin_post_cutoff"
        ),
    )


def plain_windows(requests: DataFrame, state: DataFrame) -> DataFrame:
    """The rule without a floor: start at the cutoff if training ends on or after it."""
    start = F.when(F.col("train_cutoff_pos") >= F.col("cutoff_pos"), F.col("cutoff_pos"))
    return requests.join(state, ["series_id", "train_cutoff_pos"]).withColumn(
        "train_start_pos", F.coalesce(start, F.lit(0))
    )


def actuals(panel: DataFrame) -> DataFrame:
    """Panel values keyed for the join on a test position."""
    return panel.select(
        "series_id",
        "metric",
        F.col("pos").alias("test_pos"),
        F.col("value").alias("y_true"),
        (~F.col("is_imputed") & F.col("value").isNotNull()).alias("y_true_is_observed"),
    )
