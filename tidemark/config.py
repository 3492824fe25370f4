"""All frozen parameters of the engine in one immutable object.

Every operator takes an :class:`Engine`; nothing below it hard-codes a number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Measure:
    """One measured column: a *stock* is a level, a *flow* is a count per slot."""

    name: str
    kind: str  # "stock" | "flow"


# The model names, simplest first, and the family of each.
COMPLEXITY_ORDER = (
    "naive",
    "seasonal_naive",
    "moving_average",
    "sarima",
    "exponential_smoothing",
    "random_forest",
    "gradient_boosting",
    "ensemble",
)
BASELINES = ("naive", "seasonal_naive", "moving_average")
STATISTICAL = ("sarima", "exponential_smoothing")
LEARNED = ("random_forest", "gradient_boosting")
GATE_REFERENCES = ("naive", "seasonal_naive")
ENSEMBLE = "ensemble"

# Evaluation scopes.
ALL_FOLDS = "all_dev_folds"
COMMON = "common_support"
RECENT = "post_cutoff_origins"
RECENT_COMMON = "post_cutoff_common_support"
SCOPES = (ALL_FOLDS, COMMON, RECENT, RECENT_COMMON)


@dataclass(frozen=True)
class SmoothingSpec:
    """Additive exponential smoothing; missing rows are dropped before fitting."""

    trend: bool = False
    damped: bool = False
    seasonal: bool = False
    alphas: tuple = (0.1, 0.3, 0.5, 0.7, 0.9)
    betas: tuple = (0.05, 0.1, 0.3)
    gammas: tuple = (0.1, 0.3, 0.5, 0.7, 0.9)
    phis: tuple = (0.9, 0.98)


@dataclass(frozen=True)
class ArimaSpec:
    """Seasonal ARIMA orders ``(p, d, q)(P, D, Q)``; the period is the engine's."""

    order: tuple = (0, 1, 2)
    seasonal_order: tuple = (0, 1, 1)


LEVEL_ONLY = SmoothingSpec(alphas=(0.3,))


@dataclass(frozen=True)
class Engine:
    # --- calendar: Monday = 0 ... Sunday = 6 -------------------------------
    reporting_weekdays: tuple = tuple(range(7))
    slot: str = "day"  # "day" | "hour"
    # days outside the weekday template that count as reported, as ISO dates
    off_template_days: tuple = ()

    # --- measures ----------------------------------------------------------
    measures: tuple = (
        Measure("intake", "flow"),
        Measure("release", "flow"),
        Measure("load", "stock"),
    )
    targets: tuple = ("load", "release")
    inflow: str = "intake"
    outflow: str = "release"
    level: str = "load"

    # --- features ----------------------------------------------------------
    lags: tuple = (1, 7, 14)
    windows: tuple = (7, 14)
    holiday_reach_days: int = 2

    # --- backtest ----------------------------------------------------------
    horizons: tuple = (1, 7, 14)
    first_origin_history: int = 50
    fold_step: int = 10
    holdout_real: int = 60
    rules: tuple = ("full", "capped")
    usable_floor: int = 60
    usable_ceiling: int = 80
    cap_fraction: float = 0.7
    season: int = 7
    average_window: int = 7

    # --- candidate models ---------------------------------------------------
    smoothing: dict = field(
        default_factory=lambda: {
            "load": SmoothingSpec(trend=True, damped=True, seasonal=True),
            "release": SmoothingSpec(seasonal=True),
        },
        hash=False,
    )
    arima: dict = field(
        default_factory=lambda: {
            "load": ArimaSpec(order=(2, 1, 2)),
            "release": ArimaSpec(order=(0, 1, 2)),
        },
        hash=False,
    )
    arima_buckets: int = 1
    # the two families whose per-cell winners are averaged by the ensemble
    ensemble_first: tuple = STATISTICAL
    ensemble_second: tuple = LEARNED
    min_pairs: int = 30
    trees: int = 300
    boosting_rounds: int = 300
    # tree fits are shared by all origins of so many days
    refit_days: int = 182
    # pairs of a fit that are drawn where they are only looked at (learned.pairs); a fit takes every one
    fit_rows: int | None = None
    seed: int = 42

    # --- selection ---------------------------------------------------------
    selection_scope: str = RECENT_COMMON
    selection_rule: str = "capped"
    resamples: int = 10_000
    confidence: float = 0.95
    bias_ratio_limit: float = 0.5
    # "numpy": numpy's default generator, draw for draw; "portable": an integer
    # mixing rule any SQL engine can reproduce.
    draws: str = "numpy"

    # --- intervals and signals ---------------------------------------------
    alpha: float = 0.05
    min_residuals: int = 10
    small_n: int = 40
    independence_limit: float = 0.2
    component_models: tuple = ("seasonal_naive", "moving_average")
    warn_percentile: float = 0.90
    warn_window: int = 60
    warn_grid: tuple = (0.75, 0.80, 0.85, 0.90, 0.95)
    tiers: tuple = ((14, "Watch"), (7, "Warning"), (1, "Alert"))
    elevated_fraction: float = 0.9

    @property
    def flows(self) -> tuple:
        return tuple(m.name for m in self.measures if m.kind == "flow")

    @property
    def stocks(self) -> tuple:
        return tuple(m.name for m in self.measures if m.kind == "stock")

    @property
    def measure_names(self) -> tuple:
        return tuple(m.name for m in self.measures)

    @property
    def longest_horizon(self) -> int:
        return max(self.horizons)

    @property
    def nominal(self) -> float:
        return 1.0 - self.alpha

    def with_(self, **changes) -> "Engine":
        return replace(self, **changes)


# An option: a week of five reporting days, Sunday to Thursday.
FIVE_DAY_WEEK = {"reporting_weekdays": (6, 0, 1, 2, 3), "season": 5}
