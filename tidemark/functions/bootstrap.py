"""Percentile bootstrap of a mean, over one array per group.

A group holds one number per fold, so its array is bounded by the calendar.  The
draws stay inside the array: nothing is exploded and nothing is shuffled.  Index
matrices depend only on the array length and are shared by a whole Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed value: the prime modulus of the portable draw (2^31 - 1).
MODULUS = 2_147_483_647


def portable_indices(n: int, resamples: int, seed: int) -> np.ndarray:
    """Draws in ``[0, n)`` from integer arithmetic alone.

    Two squarings modulo a prime mix replicate and draw number; products stay
    below 2^62, so any engine with 64-bit integers gives the same indices.
    """
    rep = np.arange(resamples, dtype=np.int64)[:, None]
    draw = np.arange(n, dtype=np.int64)[None, :]
    a = (rep * 7919 + draw * 104729 + seed) % MODULUS
    b = (a * a + rep * 31 + 1) % MODULUS
    c = (b * b + draw * 17 + 3) % MODULUS
    return c % n


def numpy_indices(n: int, resamples: int, seed: int) -> np.ndarray:
    """Draws of numpy's default generator."""
    return np.random.default_rng(seed).integers(0, n, size=(resamples, n))


DRAWS = {"portable": portable_indices, "numpy": numpy_indices}


def mean_interval(values: Column, draws: str, resamples: int, level: float, seed: int) -> Column:
    """``struct<ci_low, ci_high>``: percentile interval of the mean of an array column."""
    if draws not in DRAWS:
        raise ValueError(f"unknown draws {draws!r}; expected one of {sorted(DRAWS)}")
    make = DRAWS[draws]
    tail = (1.0 - level) / 2.0 * 100.0

    @F.pandas_udf("ci_low double, ci_high double")
    def interval(arrays: pd.Series) -> pd.DataFrame:
        indices: dict[int, np.ndarray] = {}
        ends = []
        for array in arrays:
            if array is None or len(array) == 0:
                ends.append((None, None))
                continue
            x = np.asarray(array, dtype=float)
            if x.size not in indices:
                indices[x.size] = make(x.size, resamples, seed)
            ends.append(tuple(np.percentile(x[indices[x.size]].mean(axis=1), [tail, 100.0 - tail])))
        return pd.DataFrame(ends, columns=["ci_low", "ci_high"], dtype="float64")

    return interval(values)


# An end this small beside the other one is zero: sums of sevenths and thirds do not cancel exactly.
TOLERANCE = 1e-9


def distinguishable(low: Column, high: Column) -> Column:
    """The interval excludes zero."""
    least = F.greatest(F.abs(low), F.abs(high)) * TOLERANCE
    return F.coalesce((low > least) | (high < -least), F.lit(False))
