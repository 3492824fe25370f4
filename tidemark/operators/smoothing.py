"""Additive exponential smoothing over a grid of parameters, fitted for every training cutoff in one fold of the series.

The starting state depends only on the first two seasons, so one pass over a series gives the squared error of a grid
point at *every* cutoff.  A row is one (series, metric, training start, grid point); a built-in ``aggregate`` folds the recursion
over its history and notes the state at the cutoffs asked for.  The best grid point of each cutoff is a partial aggregate.
The noted states are a table of fits: forecasts at any lead are column expressions over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine, SmoothingSpec

Z95 = 1.96
KEYS = ["series_id", "metric", "train_start_pos"]
# grid points folded by one task
FOLDS_PER_TASK = 64
STATE = "struct<t:int,k:int,level:double,slope:double,s:array<double>,sse:double,out:array<struct<n:int,sse:double,level:double,slope:double,s:array<double>>>>"


def smoothing_minimum(spec: SmoothingSpec, m: int) -> int:
    """Fewest finite values a fit needs."""
    return 2 * m + 4 if spec.seasonal else 6


def grid(spec: SmoothingSpec) -> list[tuple]:
    """(alpha, beta, gamma, phi), smaller parameters first; ties between grid points go to the earlier one."""
    return [
        (float(a), float(b), float(g), float(p))
        for a in spec.alphas
        for b in (spec.betas if spec.trend else (0.0,))
        for g in (spec.gammas if spec.seasonal else (0.0,))
        for p in (spec.phis if spec.trend and spec.damped else (1.0,))
    ]


def with_counts(requests: DataFrame, panel: DataFrame) -> DataFrame:
    """``requests`` with n_finite: present values from the training start to the cutoff, by two look-ups of a running count."""
    by = Window.partitionBy("series_id", "metric").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = panel.select("series_id", "metric", "pos", F.count("value").over(by).cast("int").alias("c"))
    upto = counts.select("series_id", "metric", F.col("pos").alias("train_cutoff_pos"), F.col("c").alias("_upto"))
    before = counts.select("series_id", "metric", (F.col("pos") + 1).alias("train_start_pos"), F.col("c").alias("_before"))
    made = requests.join(upto, ["series_id", "metric", "train_cutoff_pos"], "left").join(before, KEYS, "left")
    return made.withColumn("n_finite", F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))).drop("_upto", "_before")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _fold(y: str, ns: str, spec: SmoothingSpec, m: int) -> Column:
    """The noted states of one grid point (columns alpha, beta, gamma, phi) over the history ``y``."""
    season = m if spec.seasonal else 1
    alpha, beta, gamma, phi = (F.col(c) for c in ("alpha", "beta", "gamma", "phi"))
    first = F.col("first")
    start = F.struct(
        F.lit(0).alias("t"), F.lit(0).alias("k"), first.alias("level"), F.col("first_slope").alias("slope"),
        (F.transform(F.slice(y, 1, season), lambda v: v - first) if spec.seasonal else F.array(F.lit(0.0))).alias("s"),
        F.lit(0.0).alias("sse"), F.array().alias("out"),
    ).cast(STATE)

    def step(at: Column, value: Column) -> Column:
        drift = phi * at["slope"]
        # s[0] is the season of this slot; a rotation keeps it so
        error = value - (at["level"] + drift + F.get(at["s"], F.lit(0)))
        level = at["level"] + drift + alpha * error
        slope = drift + alpha * beta * error if spec.trend else at["slope"]
        s = F.concat(F.slice(at["s"], 2, season), F.array(F.get(at["s"], F.lit(0)) + gamma * (1 - alpha) * error)) if spec.seasonal else at["s"]
        sse = F.when(at["t"] >= season, at["sse"] + error * error).otherwise(at["sse"])
        return F.struct(
            (at["t"] + 1).alias("t"), at["k"].alias("k"), level.alias("level"), slope.alias("slope"), s.alias("s"), sse.alias("sse"), at["out"].alias("out")
        )

    def noted(at: Column, value: Column) -> Column:
        wanted = F.get(F.col(ns), at["k"]) == at["t"] + 1

        def note(now: Column) -> Column:
            state = F.struct(now["t"].alias("n"), now["sse"].alias("sse"), now["level"].alias("level"), now["slope"].alias("slope"), now["s"].alias("s"))
            return F.struct(
                now["t"].alias("t"), F.when(wanted, now["k"] + 1).otherwise(now["k"]).alias("k"), now["level"].alias("level"), now["slope"].alias("slope"),
                now["s"].alias("s"), now["sse"].alias("sse"), F.when(wanted, F.concat(now["out"], F.array(state))).otherwise(now["out"]).alias("out"),
            )

        return F.get(F.transform(F.array(step(at, value)), note), F.lit(0))

    return F.aggregate(y, start, noted)["out"]


def smoothing_fits(panel: DataFrame, wanted: DataFrame, specs: dict, engine: Engine) -> DataFrame:
    """One row per (series_id, metric, train_start_pos, n_finite) of ``wanted``: grid point, squared error and state after n values.

    ``wanted`` carries n_finite (see ``with_counts``) and train_cutoff_pos.  Missing slots are left out of a history; windows with too few values
    have no row.
    """
    parts = []
    for spec in dict.fromkeys(specs.values()):
        metrics = [k for k, v in specs.items() if v == spec]
        m = engine.season
        season = m if spec.seasonal else 1
        asked = wanted.filter(F.col("metric").isin(*metrics) & (F.col("n_finite") >= smoothing_minimum(spec, m)))
        places = asked.groupBy(*KEYS).agg(F.array_sort(F.collect_set("n_finite")).alias("ns"), F.max("train_cutoff_pos").alias("last"))
        values = panel.filter(F.col("value").isNotNull()).select("series_id", "metric", "pos", F.col("value").cast("double").alias("value"))
        held = values.join(places, ["series_id", "metric"]).filter(F.col("pos").between(F.col("train_start_pos"), F.col("last")))
        # bounded by the calendar: one value per slot
        history = held.groupBy(*KEYS, "ns").agg(F.array_sort(F.collect_list(F.struct("pos", "value")))["value"].alias("y"))
        history = history.withColumn("first", _mean(F.slice("y", 1, season)))
        slope = (_mean(F.slice("y", season + 1, season)) - F.col("first")) / season if spec.trend else F.lit(0.0)
        points = F.array(*[
            F.struct(F.lit(i).alias("place"), *[F.lit(v).alias(c) for c, v in zip(("alpha", "beta", "gamma", "phi"), point)])
            for i, point in enumerate(grid(spec))
        ])
        each = history.withColumn("first_slope", slope).withColumn("point", F.explode(points)).select("*", "point.*").drop("point")
        # small in bytes and long to fold: spread by count, not by size
        tasks = max(1, places.count() * len(grid(spec)) // FOLDS_PER_TASK)
        each = each.repartition(tasks, *KEYS, "place")
        states = each.select(*KEYS, "place", "alpha", "beta", "gamma", "phi", F.explode(_fold("y", "ns", spec, m)).alias("o"))
        best = states.groupBy(*KEYS, F.col("o.n").alias("n_finite")).agg(
            F.min(F.struct("o.sse", "place", "alpha", "beta", "gamma", "phi", "o.level", "o.slope", "o.s")).alias("b")
        )
        parts.append(best.select(*KEYS, "n_finite", "b.alpha", "b.beta", "b.gamma", "b.phi", "b.level", "b.slope", F.col("b.s").alias("seasonal"), "b.sse"))
    return reduce(DataFrame.unionByName, parts)


def forecast_columns(specs: dict, engine: Engine) -> tuple[Column, Column]:
    """Point and half width of the native 95% interval, ``effective_lead`` steps after a stored state."""
    lead, phi, alpha = F.col("effective_lead"), F.col("phi"), F.col("alpha")
    season = F.size("seasonal")

    def damped(steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda a, i: a + F.pow(phi, i.cast("double")))

    point = F.col("level") + F.col("slope") * damped(lead) + F.get("seasonal", (lead - 1) % season)
    trends = F.col("metric").isin(*[k for k, v in specs.items() if v.trend])
    seasons = F.col("metric").isin(*[k for k, v in specs.items() if v.seasonal])

    def weight(j: Column) -> Column:
        return (
            alpha + F.when(trends, alpha * F.col("beta") * damped(j)).otherwise(0.0)
            + F.when(seasons & (j % season == 0), F.col("gamma") * (1 - alpha)).otherwise(0.0)
        )

    steps = F.when(lead > 1, F.sequence(F.lit(1), lead - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    spread = 1.0 + F.aggregate(F.transform(steps, lambda j: weight(j) * weight(j)), F.lit(0.0), lambda a, x: a + x)
    variance = F.col("sse") / F.greatest(F.col("n_finite") - season, F.lit(1)) * spread
    return point, Z95 * F.sqrt(variance)


def forecasts_from(fits: DataFrame, requests: DataFrame, specs: dict, engine: Engine) -> DataFrame:
    """Forecasts of ``requests`` (series_id, metric, train_start_pos, train_cutoff_pos, effective_lead, n_finite) from stored fits.

    A window without a fit abstains: ``fit_failed``.  A forecast that is not finite is null: ``forecast_failed``.
    """
    rows = requests.filter(F.col("metric").isin(*specs)).join(fits, [*KEYS, "n_finite"], "left")
    point, half = forecast_columns(specs, engine)
    failed = F.col("level").isNull()
    made = rows.select(*requests.columns, failed.alias("fit_failed"), point.alias("_point"), half.alias("_half"))
    good = F.col("_point").isNotNull() & ~F.isnan("_point") & (F.abs("_point") < float("inf"))
    short = F.concat(F.lit("insufficient observations ("), F.col("n_finite").cast("string"), F.lit(" finite)"))
    return made.select(
        *requests.columns,
        F.when(good, F.col("_point")).alias("y_pred"),
        F.when(good, F.col("_point") - F.col("_half")).alias("y_pred_lo"),
        F.when(good, F.col("_point") + F.col("_half")).alias("y_pred_hi"),
        "fit_failed", (~F.col("fit_failed") & ~good).alias("forecast_failed"),
        F.when(F.col("fit_failed"), short).when(~good, "forecast is not finite").otherwise("").alias("failure_reason"),
    )


def smoothing_forecasts(panel: DataFrame, requests: DataFrame, specs: dict, engine: Engine) -> DataFrame:
    """Fit and forecast: one row per distinct (series_id, metric, train_start_pos, train_cutoff_pos, effective_lead)."""
    asked = requests.filter(F.col("metric").isin(*specs)).select(*KEYS, "train_cutoff_pos", "effective_lead").distinct()
    counted = with_counts(asked, panel)
    fits = smoothing_fits(panel, counted, specs, engine)
    return forecasts_from(fits, counted, specs, engine).drop("n_finite")
