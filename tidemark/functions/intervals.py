"""Interval, coverage and signal formulas as scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Two-sided normal quantiles by level.
Z_TABLE = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}
Z_DEFAULT = 1.96

# Capacity labels, calmest first.
CAPACITY_LABELS = ("Normal", "Elevated", "High")


def _z(level: float) -> float:
    return Z_TABLE.get(level, Z_DEFAULT)


def wilson(successes: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; NULL where ``n`` is not positive."""
    z = _z(level)
    size = F.when(n > 0, n.cast("double"))
    p = successes / size
    denominator = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / denominator
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / denominator
    low = F.when(size.isNotNull(), F.greatest(F.lit(0.0), centre - half))
    high = F.when(size.isNotNull(), F.least(F.lit(1.0), centre + half))
    return low, high


def small_sample_note(n: Column, limit: int) -> Column:
    return F.when(n < limit, F.format_string("small_sample:%d", n)).otherwise(F.lit(""))


def difference_variance(
    var_a: Column, var_b: Column, cov: Column, corr: Column, limit: float
) -> tuple[Column, Column]:
    """Variance of ``A - B`` and the form used.

    The full form is the default; independence has to be earned by a measured
    correlation below ``limit``.
    """
    independent = F.coalesce(F.abs(corr) < limit, F.lit(False))
    raw = F.when(independent, var_a + var_b).otherwise(var_a + var_b - 2 * cov)
    variance = F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))
    form = F.when(independent, F.lit("independence")).otherwise(F.lit("full_covariance"))
    return variance, form


def capacity_label(forecast: Column, threshold: Column, fraction: float) -> Column:
    """Normal when either side is missing or the threshold is not positive."""
    normal, elevated, high = CAPACITY_LABELS
    return (
        F.when(forecast.isNull() | threshold.isNull() | (threshold <= 0), F.lit(normal))
        .when(forecast > threshold, F.lit(high))
        .when(forecast >= threshold * fraction, F.lit(elevated))
        .otherwise(F.lit(normal))
    )
