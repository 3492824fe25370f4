"""The tables of one run, built on demand and staged where several steps read them.

Raw tables are aggregated once, into the master series; everything later reads
staged Parquet.  A workspace is remembered per session for as long as the input
files keep their size and change time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.config import BASELINES, FIVE_DAY_WEEK, LEARNED, LEVEL_ONLY, STATISTICAL, Engine
from tidemark.operators import (
    calendar, cleaning, features, folds, harness, imbalance, intervals, kpi, learned, quality, scoring, selection, smoothing, warning,
)
from tidemark.plans.panels import event_observations, order_observations
from tidemark.session import ship_package, side_by_side, source_stamp, stage

# The engine of the registered queries: the smoothing model is the level-only
# form and draws come from integer mixing, both of which plain SQL can repeat; the
# two averaged families are therefore made of models SQL can compute.
CHECKED = Engine(
    smoothing={"load": LEVEL_ONLY, "release": LEVEL_ONLY},
    ensemble_first=("naive", "exponential_smoothing"),
    ensemble_second=("seasonal_naive", "moving_average"),
    draws="portable",
)
CHECKED_MODELS = (*BASELINES, "exponential_smoothing")

# The engine as it stands: all seven candidates, the grid of smoothing parameters, the true ensemble, 10,000 draws.
FULL = Engine()
ALL_MODELS = (*BASELINES, *STATISTICAL, *LEARNED)

# Five reporting days and two named Fridays.
FIVE_DAY = CHECKED.with_(**FIVE_DAY_WEEK, off_template_days=("1995-03-17", "1996-06-14"))
HOURLY = CHECKED.with_(slot="hour", reporting_weekdays=tuple(range(7)), season=24)


class Workspace:
    def __init__(
        self, spark: SparkSession, observe: Callable[[], DataFrame], engine: Engine,
        models: tuple = CHECKED_MODELS, folder: str = "",
    ):
        self.spark, self.observe, self.engine, self.models = spark, observe, engine, models
        self.folder = folder
        self._learned: dict = {}

    # --- the series ---------------------------------------------------------
    @cached_property
    def obs(self) -> DataFrame:
        """Reported slots only, in wide form."""
        return calendar.keep_reporting_slots(self.raw, self.engine)

    @cached_property
    def raw(self) -> DataFrame:
        """One row per series and day, off-template days included."""
        return stage(self.observe(), "observations")

    @cached_property
    def master(self) -> DataFrame:
        made = stage(cleaning.master_series(self.raw, self.engine), "master")
        # nothing is built on a master series that breaks an invariant
        quality.enforce(quality.gate(made, self.engine))
        return made

    @cached_property
    def bounds(self) -> DataFrame:
        return stage(calendar.series_bounds(self.master, self.engine), "bounds")

    @cached_property
    def panel(self) -> DataFrame:
        return cleaning.long_panel(self.master, self.engine)

    @cached_property
    def targets(self) -> DataFrame:
        return cleaning.long_panel(self.master, self.engine, self.engine.targets)

    @cached_property
    def features(self) -> DataFrame:
        return features.feature_table(self.master, self.engine)

    # --- the backtest ---------------------------------------------------------
    @cached_property
    def folds(self) -> DataFrame:
        return folds.origin_folds(self.master, self.bounds, self.engine)

    @cached_property
    def state(self) -> DataFrame:
        return folds.training_state(self.panel, self.bounds, self.engine)

    @cached_property
    def windows(self) -> DataFrame:
        return folds.training_windows(self.folds, self.state, self.engine)

    @cached_property
    def requests(self) -> DataFrame:
        return stage(harness.requests(self.folds, self.state, self.panel, self.engine), "requests")

    @cached_property
    def predictions(self) -> DataFrame:
        """The fact table of the backtest with its common-support flag."""
        asked = self.requests  # staged before the fits that read it run side by side
        statistical, points = side_by_side(self.spark, lambda: self.statistical, lambda: self._learned_points(asked))
        made = harness.forecasts(asked, self.panel, self.engine, self.models, points, statistical)
        return stage(harness.with_common_support(made.select(*harness.COLUMNS)), "predictions")

    @cached_property
    def metrics(self) -> DataFrame:
        return stage(scoring.scoped_metrics(self.predictions), "metrics")

    @cached_property
    def pairs(self) -> DataFrame:
        targets = self.metrics.filter(F.col("metric").isin(*self.engine.targets))
        return stage(scoring.ensemble_pairs(targets, self.engine), "pairs")

    @cached_property
    def ensemble(self) -> DataFrame:
        return harness.ensemble_forecasts(self.predictions, self.pairs)

    @cached_property
    def combined(self) -> DataFrame:
        """All candidates of the targets, support recomputed over all of them."""
        targets = self.predictions.filter(F.col("metric").isin(*self.engine.targets))
        return stage(
            harness.with_common_support(harness.stack(targets, self.ensemble)), "combined"
        )

    @cached_property
    def combined_metrics(self) -> DataFrame:
        return stage(scoring.scoped_metrics(self.combined), "combined-metrics")

    @cached_property
    def residuals(self) -> DataFrame:
        """Every candidate's residuals, the ensemble's included."""
        return scoring.residuals(self.predictions).unionByName(scoring.residuals(self.ensemble))

    @cached_property
    def smoothing_fits(self) -> DataFrame:
        """Stored smoothing fits of every training window of the backtest."""
        e = self.engine
        asked = self.requests.filter(F.col("metric").isin(*e.smoothing)).select(*smoothing.KEYS, "train_cutoff_pos").distinct()
        return stage(smoothing.smoothing_fits(self.panel, smoothing.with_counts(asked, self.panel), e.smoothing, e), "smoothing-fits")

    @cached_property
    def statistical(self) -> dict[str, DataFrame]:
        """Forecasts of the statistical candidates for every training window of the backtest, made once."""
        asked, panel = self.requests, self.panel
        names = [m for m in STATISTICAL if m in self.models]
        steps = [
            lambda m=m: stage(harness.statistical_fits(asked, panel, self.engine, m), f"forecasts-{m}") for m in names
        ]
        return dict(zip(names, side_by_side(self.spark, *steps)))

    @cached_property
    def sarima(self) -> DataFrame:
        """Forecasts of every training window of the targets, each with the parameters and the status of its fit."""
        targets = self.requests.filter(F.col("metric").isin(*self.engine.targets))
        return stage(harness.forecasts(targets, self.panel, self.engine, ("sarima",)), "sarima")

    def learned_fits(self, family: str) -> DataFrame:
        """The stored fits of one tree family, made once; with it, those of every other family among the candidates."""
        if family not in self._learned:
            together = tuple(f for f in LEARNED if f in self.models) if family in self.models else (family,)
            made = learned.fit_table(self.requests, self.features, self.targets, self.engine, *together)
            kept = stage(made, f"fits-{'-'.join(together)}", ("family",))
            self._learned |= {f: kept.filter(F.col("family") == f) for f in together}
        return self._learned[family]

    def learned(self, family: str) -> DataFrame:
        """Forecasts of all requests of the targets by one tree family."""
        return learned.apply_fits(self.requests, self.features, self.learned_fits(family), self.engine).withColumn("model", F.lit(family))

    # --- selection -----------------------------------------------------------
    @cached_property
    def evidence(self) -> DataFrame:
        points = selection.scope_points(self.combined, self.engine.selection_scope, self.engine)
        return stage(selection.candidate_evidence(points, self.engine), "evidence")

    @cached_property
    def champions(self) -> DataFrame:
        return stage(selection.decide(self.evidence), "champions")

    @cached_property
    def governing_cells(self) -> DataFrame:
        e = self.engine
        return self.combined_metrics.filter(
            (F.col("fold_scope") == e.selection_scope) & (F.col("window_rule") == e.selection_rule)
        )

    # --- intervals, signals, indicators ---------------------------------------
    @cached_property
    def pool(self) -> DataFrame:
        return intervals.residual_pool(self.residuals, self.engine)

    @cached_property
    def quantiles(self) -> DataFrame:
        return intervals.pool_quantiles(self.pool, self.engine)

    def _points(self, requests: DataFrame) -> DataFrame:
        # later requests mostly ask for windows that the backtest has fitted; the others are fitted here
        stored = {m: harness.statistical_fits(requests, self.panel, self.engine, m, made) for m, made in self.statistical.items()}
        return intervals.candidate_points(
            requests, self.panel, self.engine, self.models, self.pairs, self._learned_points(requests), stored
        )

    def _learned_points(self, requests: DataFrame) -> DataFrame | None:
        """Forecasts of the candidate tree families for any requests, from fits made once for the backtest."""
        made = [
            learned.apply_fits(requests, self.features, self.learned_fits(f), self.engine).withColumn("model", F.lit(f))
            for f in LEARNED if f in self.models
        ]
        return reduce(DataFrame.unionByName, made) if made else None

    @cached_property
    def forward(self) -> DataFrame:
        asked = intervals.forward_requests(self.master, self.bounds, self.state, self.engine)
        return stage(
            intervals.forward_forecasts(self._points(asked), self.champions, self.quantiles, self.engine),
            "forward",
        )

    @cached_property
    def coverage(self) -> DataFrame:
        return intervals.pooled_coverage(self.pool, self.champions, self.engine)

    @cached_property
    def holdout_folds(self) -> DataFrame:
        return folds.origin_folds(self.master, self.bounds, self.engine, "holdout")

    @cached_property
    def holdout(self) -> DataFrame:
        asked = intervals.plain_requests(self.holdout_folds, self.state, self.engine)
        return stage(
            intervals.holdout_evaluation(
                self._points(asked), self.champions, self.quantiles, self.panel, self.engine
            ),
            "holdout",
        )

    @cached_property
    def component(self) -> DataFrame:
        return imbalance.component_residuals(self.predictions, self.engine)

    @cached_property
    def outflow_residuals(self) -> DataFrame:
        return self.residuals.filter(F.col("metric") == self.engine.outflow)

    @cached_property
    def imbalance(self) -> DataFrame:
        e = self.engine
        asked = intervals.forward_requests(
            self.master, self.bounds, self.state, e, (e.inflow, e.outflow)
        )
        plain = harness.forecasts(
            asked.filter(F.col("metric") == e.inflow), self.panel, e, BASELINES
        )
        both = plain.unionByName(self._points(asked.filter(F.col("metric") == e.outflow)))
        recent = self.outflow_residuals.filter(
            F.col("origin_post_cutoff") & (F.col("window_rule") == e.selection_rule)
        )
        return imbalance.imbalance_forecast(both, self.champions, self.component, recent, e)

    @cached_property
    def development_points(self) -> DataFrame:
        asked = intervals.plain_requests(self.folds, self.state, self.engine)
        return stage(self._points(asked), "development-points")

    @cached_property
    def backtest(self) -> DataFrame:
        return stage(
            warning.replay(self.development_points, self.champions, self.targets, self.engine), "backtest"
        )

    @cached_property
    def backtest_grid(self) -> DataFrame:
        return warning.replay(
            self.development_points, self.champions, self.targets, self.engine, self.engine.warn_grid
        )

    @cached_property
    def kpis(self) -> DataFrame:
        e = self.engine
        levels = warning.thresholds(self.targets, e).join(
            self.bounds.select("series_id", F.col("last_real_pos").alias("pos")), ["series_id", "pos"]
        )
        summary = warning.summarise(self.backtest, ["series_id", "metric"])
        return kpi.kpis(
            self.champions, self.combined_metrics, self.forward, levels, summary, self.holdout, e
        )


_remembered: dict = {}


def open_workspace(
    spark: SparkSession, folder: str, engine: Engine = CHECKED, key: str = "priority",
    models: tuple = CHECKED_MODELS, fresh: bool = False,
) -> Workspace:
    """The workspace of a folder of raw tables; ``key`` "events" takes the hourly one."""
    ship_package(spark)
    stamp = source_stamp(
        spark, *[f"{folder}/{t}.parquet" for t in ("orders", "lineitem", "customer", "events")]
    )
    name = (spark.sparkContext.applicationId, key, repr(engine), models, stamp)
    if fresh or name not in _remembered:
        if key == "events":
            def observe() -> DataFrame:
                return event_observations(spark, folder, engine)
        else:
            def observe() -> DataFrame:
                return order_observations(spark, folder, engine, key)
        made = Workspace(spark, observe, engine, models, folder)
        if fresh:
            return made
        _remembered[name] = made
    return _remembered[name]
