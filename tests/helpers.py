"""Small series built by hand."""

from datetime import date, timedelta

import numpy as np

from tidemark.config import FIVE_DAY_WEEK, LEVEL_ONLY, Engine

ENGINE = Engine(smoothing={"load": LEVEL_ONLY, "release": LEVEL_ONLY}, **FIVE_DAY_WEEK)
MASTER = (
    "series_id string, ds date, pos int, is_imputed boolean, intake bigint, release bigint, load bigint, "
    "is_imputed_load boolean"
)
PANEL = "series_id string, metric string, kind string, ds date, pos int, value double, is_imputed boolean"
START = date(2023, 1, 1)


def panel(spark, values, gaps=(), metric="load", series="s"):
    kind = "stock" if metric == "load" else "flow"
    rows = [
        (series, metric, kind, START + timedelta(days=i), i, None if v is None else float(v), i in set(gaps))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, PANEL)


def master(spark, n, gaps=(), series="s", load=None, flow=None):
    gaps = set(gaps)
    rows = []
    for i in range(n):
        gap = i in gaps
        f = None if gap else (flow(i) if flow else i % 7)
        rows.append((series, START + timedelta(days=i), i, gap, f, f, load(i) if load else i, gap))
    return spark.createDataFrame(rows, MASTER)


def bounds(spark, n, cutoff, dev_end=None, holdout=None, series="s"):
    schema = "series_id string, n_slots bigint, cutoff_pos int, last_real_pos int, holdout_start_pos int, dev_end_pos int"
    dev_end = n - 1 if dev_end is None else dev_end
    return spark.createDataFrame([(series, n, cutoff, n - 1, holdout or dev_end + 1, dev_end)], schema)


def prediction_rows(spark, models, actuals, forecasts, metric="load", horizon=1):
    """Scorable, common-support, post-cutoff rows of the deployed rule."""
    rows = [
        ("s", metric, m, "capped", i, horizon, float(y), True, None if f is None else float(f), True, True)
        for m, fs in zip(models, forecasts)
        for i, (y, f) in enumerate(zip(actuals, fs))
    ]
    return spark.createDataFrame(
        rows,
        "series_id string, metric string, model string, window_rule string, fold_id int, horizon int, y_true double, "
        "y_true_is_observed boolean, y_pred double, origin_post_cutoff boolean, common_support boolean",
    )


# exponential smoothing step by step, to hold the folded form against
def smoothing_states(y: np.ndarray, spec, m: int, wanted: set[int]) -> dict:
    """Run every grid point over ``y`` (no gaps) once.

    For each requested prefix length, keep the best grid point so far and its
    state: ``{n: (alpha, beta, gamma, phi, level, slope, seasonal, sse)}``.
    """
    season = m if spec.seasonal else 1
    grid = np.array(
        [
            (a, b, g, p)
            for a in spec.alphas
            for b in (spec.betas if spec.trend else (0.0,))
            for g in (spec.gammas if spec.seasonal else (0.0,))
            for p in (spec.phis if spec.trend and spec.damped else (1.0,))
        ]
    )
    alpha, beta, gamma, phi = grid.T
    first = y[:season].mean()
    level = np.full(len(grid), first)
    slope = np.full(len(grid), (y[season : 2 * season].mean() - first) / season if spec.trend else 0.0)
    seasonal = np.tile((y[:season] - first) if spec.seasonal else [0.0], (len(grid), 1))
    sse = np.zeros(len(grid))
    out = {}
    for t in range(y.size):
        s = seasonal[:, t % season]
        drift = phi * slope
        error = y[t] - (level + drift + s)
        if t >= season:  # the first season only sets the starting state
            sse = sse + error * error
        level = level + drift + alpha * error
        if spec.trend:
            slope = drift + alpha * beta * error
        if spec.seasonal:
            seasonal[:, t % season] = s + gamma * (1 - alpha) * error
        if t + 1 in wanted:
            best = int(np.argmin(sse))  # ties go to the smaller parameters
            out[t + 1] = (*grid[best], level[best], slope[best], seasonal[best].copy(), sse[best])
    return out


def smoothing_forecast(state: tuple, n: int, lead: int, spec) -> tuple:
    """Point and native 95% interval ``lead`` steps after the first ``n`` values."""
    alpha, beta, gamma, phi, level, slope, seasonal, sse = state
    width = seasonal.size
    damped = np.cumsum(phi ** np.arange(1, lead + 1))
    point = level + slope * damped[-1] + seasonal[(n + lead - 1) % width]
    weight = np.full(lead - 1, alpha)
    if spec.trend:
        weight = weight + alpha * beta * damped[: lead - 1]
    if spec.seasonal:
        weight = weight + gamma * (1 - alpha) * (np.arange(1, lead) % width == 0)
    variance = sse / max(n - width, 1) * (1.0 + np.sum(weight * weight))
    half = 1.96 * np.sqrt(variance)
    return float(point), float(point - half), float(point + half)
