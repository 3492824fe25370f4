"""The three reference forecasters, as expressions over a training state.

A row needs ``last_seen``, ``recent``, ``train_start_pos``, ``train_cutoff_pos``
and a lead; the forecast is then column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import BASELINES, Engine


def naive() -> Column:
    """The last present value inside the training window, at any lead."""
    inside = F.col("last_seen.pos") >= F.col("train_start_pos")
    return F.when(inside, F.col("last_seen.value"))


def seasonal_naive(lead: Column, engine: Engine) -> Column:
    """The value one season back from the target, from the window's last season.

    NULL where that slot is missing or the window is shorter than one season.
    """
    m = engine.season
    back = m - 1 - (lead - 1) % m
    enough = F.col("train_cutoff_pos") - F.col("train_start_pos") + 1 >= m
    return F.when(enough, F.get(F.col("recent"), back.cast("int")))


def moving_average(engine: Engine) -> Column:
    """Mean of the last slots, gaps skipped and the window clipped to training."""
    total, present = F.lit(0.0), F.lit(0)
    for k in range(engine.average_window):
        value = F.get(F.col("recent"), F.lit(k))
        usable = value.isNotNull() & (
            F.col("train_cutoff_pos") - k >= F.col("train_start_pos")
        )
        total = total + F.when(usable, value).otherwise(F.lit(0.0))
        present = present + F.when(usable, F.lit(1)).otherwise(F.lit(0))
    return F.try_divide(total, present.cast("double"))


def baseline_forecasts(
    rows: DataFrame, engine: Engine, models: tuple = BASELINES, lead: str = "effective_lead"
) -> DataFrame:
    """One output row per input row and model: ``model, y_pred``."""
    formulas = {
        "naive": naive(),
        "seasonal_naive": seasonal_naive(F.col(lead), engine),
        "moving_average": moving_average(engine),
    }
    unknown = set(models) - set(formulas)
    if unknown:
        raise ValueError(f"no baseline named {sorted(unknown)}")
    each = F.array(
        *[F.struct(F.lit(m).alias("model"), formulas[m].alias("y_pred")) for m in models]
    )
    return rows.select("*", F.inline(each)).drop("last_seen", "recent")
