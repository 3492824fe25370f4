"""Seasonal ARIMA, fitted per series inside tasks.

Spark groups the requests of one (series, metric, training start) with that
series' history; the fit is a few vectorised numpy steps.  Histories are bounded
by the calendar, so a group never grows with the raw data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.config import ArimaSpec, Engine

Z95 = 1.96
KEYS = ["series_id", "metric", "train_start_pos"]
OUTPUT = (
    "series_id string, metric string, train_start_pos int, train_cutoff_pos int, "
    "effective_lead int, y_pred double, y_pred_lo double, y_pred_hi double, "
    "fit_failed boolean, forecast_failed boolean, failure_reason string, "
    "fit_status string, parameters array<double>, n_residuals int, residual_sd double"
)
CONVERGED, BOUNDARY, UNFINISHED, ABSTAINED = "converged", "boundary", "step limit", "abstained"


def _abstain(requests: pd.DataFrame, reason: str) -> pd.DataFrame:
    return requests.assign(
        y_pred=np.nan, y_pred_lo=np.nan, y_pred_hi=np.nan, fit_failed=True, forecast_failed=False, failure_reason=reason,
        fit_status=ABSTAINED, parameters=None, n_residuals=0, residual_sd=np.nan,
    )


# -------------------------------------------------------------------- arima
NUDGE = 1e-4
FOLDS_AT_ONCE = 256
EDGE = 5.0  # tanh(5) = 0.9999


def stable(u: np.ndarray) -> np.ndarray:
    """Unbounded numbers -> coefficients c of a polynomial 1 + c1 B + ... with its
    roots outside the unit circle, through partial correlations.  Rows are taken one by one."""
    c = np.zeros((*u.shape[:-1], 0))
    for r in np.moveaxis(np.tanh(u), -1, 0)[..., None]:
        c = np.concatenate([c + r * c[..., ::-1], r], axis=-1)
    return c


def lags_of(plain: int, seasonal: int, m: int) -> list[int]:
    """The lags of the product of a plain and a seasonal lag polynomial, 0 left out."""
    return sorted({i + m * j for i in range(plain + 1) for j in range(seasonal + 1)} - {0})


def products(plain: np.ndarray, seasonal: np.ndarray, m: int) -> dict[int, np.ndarray]:
    """Coefficient by lag of that product, for rows of coefficients."""
    out: dict[int, np.ndarray] = {}
    one = np.ones(plain.shape[:-1])
    for i, a in enumerate([one, *np.moveaxis(plain, -1, 0)]):
        for j, b in enumerate([one, *np.moveaxis(seasonal, -1, 0)]):
            if i + j:
                out[i + m * j] = out.get(i + m * j, 0.0) + a * b
    return out


def expansion(numerator: np.ndarray, denominator: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` weights of numerator(B) / denominator(B)."""
    out = np.zeros(length)
    out[: numerator.size] = numerator[:length]
    for t in range(1, length):
        k = min(t, denominator.size - 1)
        out[t] -= denominator[1 : k + 1] @ out[t - k : t][::-1]
    return out


def difference_of(spec: ArimaSpec, m: int) -> np.ndarray:
    """The polynomial of the plain and seasonal differences."""
    out = np.array([1.0])
    for _ in range(spec.order[1]):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(spec.seasonal_order[1]):
        out = np.convolve(out, np.r_[1.0, np.zeros(m - 1), -1.0])
    return out


class _Folds:
    """Histories of several cutoffs of one series, differenced, side by side: (slots, folds)."""

    def __init__(self, y: np.ndarray, ends: list[int], spec: ArimaSpec, m: int):
        (p, _, q), (P, _, Q) = spec.order, spec.seasonal_order
        self.spec, self.m, self.ends, self.sizes = spec, m, ends, (p, P, q, Q)
        self.count = p + P + q + Q
        self.difference = difference_of(spec, m)
        reach = self.difference.size - 1
        whole = pd.Series(y).interpolate(limit_direction="both").to_numpy()
        gap = ~np.isfinite(y)
        touched = np.convolve(gap.astype(float), np.abs(self.difference))[reach : y.size] > 0
        slots = max(ends) - reach
        self.w, self.fit, self.bridged = np.zeros((slots, len(ends))), np.zeros((slots, len(ends)), bool), []
        for f, n in enumerate(ends):
            own = whole[:n].copy()
            last = n - 1
            while gap[last]:  # nothing after the cutoff may shape what stands before it
                last -= 1
            own[last + 1 :] = y[last]
            self.bridged.append(own)
            self.w[: n - reach, f] = np.convolve(own, self.difference)[reach:n]
            self.fit[: n - reach, f] = ~touched[: n - reach]
        self.fit[: p + P * m] = False

    def split(self, u: np.ndarray) -> tuple[dict, dict]:
        parts = np.split(u, np.cumsum(self.sizes)[:-1], axis=-1)
        return products(stable(parts[0]), stable(parts[1]), self.m), products(stable(parts[2]), stable(parts[3]), self.m)

    def innovations(self, u: np.ndarray, folds: np.ndarray) -> np.ndarray:
        """The whole innovation recursion for (folds, vectors, parameters): (slots, folds, vectors)."""
        ar, ma = self.split(u)
        w = self.w[:, folds, None]
        e = np.repeat(w, u.shape[1], axis=2)
        for lag, c in ar.items():
            e[lag:] += c * w[:-lag]
        steps = [(lag, np.ascontiguousarray(c)) for lag, c in ma.items()]
        product = np.empty(e.shape[1:])
        for t in range(1, len(e)):
            now = e[t]
            for lag, c in steps:
                if lag <= t:
                    np.multiply(c, e[t - lag], out=product)
                    now -= product
        return e


def arima_parameters(held: _Folds, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Conditional least squares for all folds at once by damped Gauss-Newton steps.

    Returns parameters (folds, count), squared errors, innovations (slots, folds) and a status for each fold: converged, boundary (a root
    has reached the unit circle, where the sum of squares is flat) or step limit.
    """
    folds, count = len(held.ends), held.count
    (p, P, q, Q) = held.sizes
    u = np.tile(np.r_[np.full(p + P, -0.1), np.full(q + Q, -0.3)], (folds, 1))
    nudges = np.vstack([np.zeros(count), NUDGE * np.eye(count)])
    every = np.arange(folds)
    around = held.innovations(u[:, None, :] + nudges, every) * held.fit[:, :, None]
    sse = np.einsum("tf,tf->f", around[:, :, 0], around[:, :, 0])
    total = np.einsum("tf,tf->f", held.w, held.w)
    damping, status = np.full(folds, 1e-2), np.full(folds, UNFINISHED, object)
    status[(sse <= 1e-12 * total) | (count == 0)] = CONVERGED
    slopes = np.zeros((folds, count, count)), np.zeros((folds, count))
    fresh = every
    for _ in range(steps):
        if len(fresh):
            part = (around[:, :, 1:] - around[:, :, :1]) / NUDGE
            slopes[0][fresh] = np.einsum("tfk,tfl->fkl", part, part, optimize=True)
            slopes[1][fresh] = np.einsum("tfk,tf->fk", part, around[:, :, 0], optimize=True)
        open_ = np.flatnonzero(status == UNFINISHED)
        if not len(open_):
            break
        gram, pull = slopes[0][open_], slopes[1][open_]
        diagonal = np.einsum("fkk->fk", gram)
        damped = gram + np.einsum("fk,kl->fkl", damping[open_, None] * (diagonal + 1e-12 * (1 + diagonal.max(1, keepdims=True))), np.eye(count))
        move = np.linalg.solve(damped, pull[:, :, None])[:, :, 0]
        trial = u[open_] - np.clip(move, -1.0, 1.0)
        tried = held.innovations(trial[:, None, :] + nudges, open_) * held.fit[:, open_, None]
        error = np.einsum("tf,tf->f", tried[:, :, 0], tried[:, :, 0])
        better = error < sse[open_]
        gain = np.where(better, sse[open_] - error, 0.0)
        settled = better & (gain <= 1e-9 * sse[open_]) | ~better & (damping[open_] > 1e8)
        fresh, around = open_[better], tried[:, better]
        u[fresh], sse[fresh] = trial[better], error[better]
        damping[open_] = np.where(better, damping[open_] / 4, damping[open_] * 8)
        status[open_[settled]] = CONVERGED
        # tanh has saturated: a root has come to the unit circle
        status[open_[(np.abs(u[open_]) > EDGE).any(axis=1)]] = BOUNDARY
    return u, sse, held.innovations(u[:, None, :], every)[:, :, 0], status


def _polynomial(terms: dict[int, np.ndarray], fold: int) -> np.ndarray:
    out = np.zeros(max(terms, default=0) + 1)
    out[0] = 1.0
    for lag, c in terms.items():
        out[lag] = c[fold]
    return out


def arima_paths(held: _Folds, leads: list[list[int]]) -> list[dict]:
    """Per fold: the fit, and ``{lead: (point, half width)}``."""
    u, sse, e, status = arima_parameters(held)
    ar, ma = held.split(u)
    out, reach = [], held.difference.size - 1
    for f, n in enumerate(held.ends):
        horizon = max(leads[f])
        whole = np.convolve(_polynomial(ar, f), held.difference)  # polynomial of the undifferenced series
        moving = _polynomial(ma, f)
        path = np.r_[held.bridged[f], np.zeros(horizon)]
        noise = np.r_[np.zeros(reach), e[: n - reach, f], np.zeros(horizon)]
        for t in range(n, n + horizon):
            k, j = min(t, whole.size - 1), min(t, moving.size - 1)
            path[t] = moving[1 : j + 1] @ noise[t - j : t][::-1] - whole[1 : k + 1] @ path[t - k : t][::-1]
        used = int(held.fit[:, f].sum())
        sigma = np.sqrt(sse[f] / max(used - held.count, 1))
        half = Z95 * sigma * np.sqrt(np.cumsum(np.square(expansion(moving, whole, horizon))))
        out.append({
            "status": status[f], "parameters": np.tanh(u[f]).tolist(), "used": used, "sigma": float(sigma),
            "made": {h: (float(path[n + h - 1]), float(half[h - 1])) for h in leads[f]},
        })
    return out


def arima_forecast(y: np.ndarray, leads: list[int], spec: ArimaSpec, m: int) -> dict[int, tuple[float, float]] | None:
    """``{lead: (point, half width)}`` after the last of ``y``; None where too few differences are complete.

    Gaps are bridged linearly so that the recursion can run, but a difference that touches one is left out of the fit.
    """
    held = _Folds(y, [y.size], spec, m)
    if held.fit.sum() < held.count + 2:
        return None
    return arima_paths(held, [leads])[0]["made"]


# Values a fit needs besides those its differences use up.
VALUES_PER_TERM, LEAST_SEASONS, SPARE_VALUES = 3, 2, 2


def arima_minimum(spec: ArimaSpec, m: int) -> int:
    """Fewest finite values of a fit."""
    plain, seasonal = spec.order, spec.seasonal_order
    used_up = plain[1] + m * seasonal[1]
    terms = sum(plain[::2]) + sum(seasonal[::2])
    return used_up + max(VALUES_PER_TERM * terms, LEAST_SEASONS * m) + SPARE_VALUES


def _arima_group(spec: ArimaSpec, m: int, pos, value, requests: pd.DataFrame) -> pd.DataFrame:
    """All cutoffs of one series and start, fitted side by side; one that cannot be fitted abstains alone."""
    start = int(requests["train_start_pos"].iloc[0])
    y = value[pos >= start]
    at = pos[pos >= start]
    parts, able = [], []
    for cutoff, group in requests.groupby("train_cutoff_pos", sort=True):
        n = int(np.searchsorted(at, cutoff, side="right"))
        finite = int(np.isfinite(y[:n]).sum())
        if finite < arima_minimum(spec, m):
            parts.append(_abstain(group, f"insufficient observations ({finite} finite)"))
        elif _Folds(y[:n], [n], spec, m).fit.sum() < sum(spec.order[::2]) + sum(spec.seasonal_order[::2]) + 2:
            parts.append(_abstain(group, "too few complete rows to estimate the terms"))
        else:
            able.append((n, group))
    for begin in range(0, len(able), FOLDS_AT_ONCE):
        parts += _fit_together(spec, m, y, able[begin : begin + FOLDS_AT_ONCE])
    return pd.concat(parts, ignore_index=True)


def _fit_together(spec: ArimaSpec, m: int, y: np.ndarray, able: list[tuple]) -> list[pd.DataFrame]:
    """Fits of several cutoffs; if that raises, each is tried alone, so that one bad cutoff fails by itself."""
    leads = [[int(x) for x in group["effective_lead"]] for _, group in able]
    try:
        made = arima_paths(_Folds(y[: max(n for n, _ in able)], [n for n, _ in able], spec, m), leads)
    except (np.linalg.LinAlgError, FloatingPointError, ValueError) as problem:
        if len(able) == 1:
            return [_abstain(able[0][1], f"{type(problem).__name__}: {problem}")]
        return [part for one in able for part in _fit_together(spec, m, y, [one])]
    out = []
    for fit, (_, group) in zip(made, able):
        point = np.array([fit["made"][int(x)][0] for x in group["effective_lead"]])
        half = np.array([fit["made"][int(x)][1] for x in group["effective_lead"]])
        bad = ~np.isfinite(point)
        out.append(group.assign(
            y_pred=point, y_pred_lo=point - half, y_pred_hi=point + half, fit_failed=False, forecast_failed=bad,
            failure_reason=np.where(bad, "forecast is not finite", ""), fit_status=fit["status"],
            parameters=[fit["parameters"]] * len(group), n_residuals=fit["used"], residual_sd=fit["sigma"],
        ))
    return out


# ------------------------------------------------------------------- Spark
def _fit(
    panel: DataFrame, requests: DataFrame, specs: dict, engine: Engine, group, buckets: int = 1
) -> DataFrame:
    """Cogroup requests with histories and run ``group`` inside the tasks.

    ``buckets`` splits the folds of one series over several tasks, each with its
    own copy of the history; worth it where the fit, not the data, is the cost.
    Both sides are spread explicitly, because these groups are small in bytes and
    would otherwise be coalesced into a single task.
    """
    season = engine.season
    asked_columns = [*KEYS, "train_cutoff_pos", "effective_lead"]
    bucket = F.pmod(F.hash("train_cutoff_pos"), F.lit(buckets))
    # fresh names: both cogroup sides come from the same plans
    wanted = (
        requests.filter(F.col("metric").isin(*specs))
        .select(*[F.col(c).alias(f"asked_{c}") for c in asked_columns], bucket.alias("asked_bucket"))
        .distinct()
    )
    keys = [*KEYS, "bucket"]
    asked_keys = [f"asked_{k}" for k in keys]
    # history once per (series, metric, start, bucket); starts are two per series at most
    starts = wanted.select(*[F.col(f"asked_{k}").alias(k) for k in keys]).distinct()
    history = (
        panel.select("series_id", "metric", "pos", "value")
        .join(starts, ["series_id", "metric"])
        .filter(F.col("pos") >= F.col("train_start_pos"))
    )
    width = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    history = history.repartition(width, *keys)
    wanted = wanted.repartition(width, *asked_keys)

    def run(past: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in OUTPUT.split(", ")])
        asked = asked[[f"asked_{c}" for c in asked_columns]].set_axis(asked_columns, axis=1)
        past = past.sort_values("pos")
        spec = specs[asked["metric"].iloc[0]]
        made = group(
            spec, season, past["pos"].to_numpy(), past["value"].to_numpy(dtype=float), asked
        )
        # NULL, never NaN, is the engine's "abstained"
        for c in ("y_pred", "y_pred_lo", "y_pred_hi", "residual_sd"):
            made[c] = made[c].astype(object).where(np.isfinite(made[c].astype(float)), None)
        return made

    return history.groupBy(*keys).cogroup(wanted.groupBy(*asked_keys)).applyInPandas(run, OUTPUT)


def arima_fits(panel: DataFrame, requests: DataFrame, specs: dict, engine: Engine) -> DataFrame:
    """Forecasts for ``requests`` (series, metric, start, cutoff, lead)."""
    return _fit(panel, requests, specs, engine, _arima_group, engine.arima_buckets)


def attach(rows: DataFrame, fits: DataFrame, model: str) -> DataFrame:
    """Put fitted forecasts back on the rows that asked for them."""
    keys = [*KEYS, "train_cutoff_pos", "effective_lead"]
    return rows.drop("last_seen", "recent").join(fits, keys).withColumn("model", F.lit(model))
