"""Forecast-error measures as aggregate column expressions.

``y`` is the actual and ``f`` the forecast.  A pair counts only where both are
present; every expression skips the rest by being NULL there, so each measure is
one partial aggregate and needs no prior filter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def paired(y: Column, f: Column) -> Column:
    return y.isNotNull() & f.isNotNull()


def abs_error(y: Column, f: Column) -> Column:
    return F.abs(y - f)


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((y - f) * (y - f)))


def mean_error(y: Column, f: Column) -> Column:
    return F.avg(f - y)


def mape(y: Column, f: Column) -> Column:
    """Percent; zero actuals are left out rather than padded."""
    return F.avg(F.when(y != 0, F.abs((y - f) / F.nullif(y, F.lit(0.0))))) * 100


def smape(y: Column, f: Column) -> Column:
    """Percent on the 0-200 convention; a pair of zeros contributes 0."""
    size = (F.abs(y) + F.abs(f)) / 2
    ratio = F.when(size == 0, F.lit(0.0)).otherwise(
        F.abs(y - f) / F.nullif(size, F.lit(0.0))
    )
    return F.avg(ratio) * 100


def mase(y: Column, f: Column, scale: Column) -> Column:
    """One scale for the whole group, taken as its largest usable value."""
    return F.try_divide(mae(y, f), F.max(F.when(scale > 0, scale)))


def pooled_mase(y: Column, f: Column, scale: Column) -> Column:
    """Each error divided by the scale of its own fold, then averaged."""
    return F.avg(F.when(scale > 0, F.abs(y - f) / F.nullif(scale, F.lit(0.0))))


def zero_actuals(y: Column, f: Column) -> Column:
    return F.count_if(paired(y, f) & (y == 0))


def measures(y: Column, f: Column, scale: Column | None = None) -> list[Column]:
    """Every measure plus the accounting that says what it rests on."""
    return [
        F.count_if(paired(y, f)).alias("n_scored"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(y.isNull()).alias("n_missing_actual"),
        F.count_if(y.isNotNull() & f.isNull()).alias("n_missing_pred"),
        zero_actuals(y, f).alias("n_zero_actual_excluded_from_mape"),
        mae(y, f).alias("MAE"),
        rmse(y, f).alias("RMSE"),
        mape(y, f).alias("MAPE"),
        smape(y, f).alias("sMAPE"),
        (F.lit(None).cast("double") if scale is None else pooled_mase(y, f, scale)).alias("MASE"),
        mean_error(y, f).alias("ME_bias"),
    ]


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the pairs present; NULL where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), F.nullif(spread, F.lit(0.0)))
