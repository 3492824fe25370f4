"""Exploratory statistics: breaks, seasonality, autocorrelation, stationarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.config import Engine
from tidemark.functions.scores import correlation
from tidemark.operators.cleaning import by_metric
from tidemark.operators.quality import weekday_name

TARGET = ["series_id", "metric"]
# 5% critical values (trend-form KPSS, constant-form ADF).
KPSS_5PCT = 0.146
ADF_5PCT = -2.86


def whole() -> Window:
    return Window.partitionBy(*TARGET)


def present(panel: DataFrame) -> DataFrame:
    """Non-missing values with a gap-free index ``i`` from 0 and the count ``n``."""
    kept = panel.filter(F.col("value").isNotNull())
    return kept.select(
        *TARGET, "pos", "ds", "is_imputed", "value",
        (F.row_number().over(by_metric()) - 1).alias("i"),
        F.count(F.lit(1)).over(whole()).alias("n"),
    )


def differenced(panel: DataFrame) -> DataFrame:
    """The same layout over first differences of the present values."""
    step = panel.filter(F.col("value").isNotNull()).select(
        *TARGET, "pos", "ds", "is_imputed",
        (F.col("value") - F.lag("value").over(by_metric())).alias("value"),
    )
    return present(step)


def breaks(panel: DataFrame) -> DataFrame:
    """Largest cumulative deviation from the mean, and the largest in the other half."""
    rows = present(panel)
    centred = rows.select("*", (F.col("value") - F.avg("value").over(whole())).alias("dev"))
    frame = by_metric().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rounded far below any real difference, so equal sums tie the same everywhere
    path = centred.select(
        *TARGET, "ds", "i", "n", F.round(F.sum("dev").over(frame), 3).alias("cusum")
    ).withColumn("late", F.col("i") >= F.floor(F.col("n") / 2))
    strongest = F.struct(F.abs("cusum").alias("size"), (-F.col("i")).alias("first"))
    where = F.struct("ds", "i", "cusum", "late")
    table = path.groupBy(*TARGET).agg(
        F.max_by(where, strongest).alias("dominant"),
        F.max_by(where, F.when(F.col("late"), strongest)).alias("in_late"),
        F.max_by(where, F.when(~F.col("late"), strongest)).alias("in_early"),
    )
    second = F.when(F.col("dominant.late"), F.col("in_early")).otherwise(F.col("in_late"))
    return table.select(
        *TARGET,
        F.col("dominant.ds").alias("dominant_ds"), F.col("dominant.cusum").alias("dominant_cusum"),
        second["ds"].alias("secondary_ds"), second["cusum"].alias("secondary_cusum"),
    )


def chi_square_tail(statistic: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for any whole number of degrees of freedom.

    Even ones have a finite sum; for odd ones the series of the lower incomplete gamma function is summed.
    """
    h, a = statistic / 2, df.cast("double") / 2
    even = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.floor(a).cast("int") - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda at, i: F.struct((at["term"] * h / (i + 1)).alias("term"), (at["sum"] + at["term"]).alias("sum")),
        lambda at: F.exp(-h) * at["sum"],
    )
    # gamma(a + 1) = sqrt(pi) x 1/2 x 3/2 x ... x a
    gamma = F.aggregate(F.sequence(F.lit(0), F.floor(a).cast("int")), F.lit(math.sqrt(math.pi)), lambda x, i: x * (i + 0.5))
    terms = F.sequence(F.lit(1), (F.ceil(h * 2) + 60).cast("int"))
    lower = F.aggregate(
        terms, F.struct((F.pow(h, a) * F.exp(-h) / gamma).alias("term"), F.lit(0.0).alias("sum")),
        lambda at, i: F.struct((at["term"] * h / (a + i)).alias("term"), (at["sum"] + at["term"]).alias("sum")),
        lambda at: at["sum"] + at["term"],
    )
    odd = F.when(h > 500, 0.0).otherwise(F.greatest(1 - lower, F.lit(0.0)))
    tail = F.when(~(statistic > 0), 1.0).when(df % 2 == 0, even).otherwise(odd)
    return F.when(statistic.isNotNull() & ~F.isnan(statistic) & (df > 0), tail)


def kruskal_wallis(panel: DataFrame, on_differences: bool = False) -> DataFrame:
    """Tie-corrected H of the observed values (or their differences) by weekday."""
    rows = panel.filter(~F.col("is_imputed") & F.col("value").isNotNull())
    if on_differences:
        rows = rows.select(
            *TARGET, "ds", (F.col("value") - F.lag("value").over(by_metric())).alias("value")
        ).filter(F.col("value").isNotNull())
    value_order = Window.partitionBy(*TARGET).orderBy("value")
    same = Window.partitionBy(*TARGET, "value")
    ranked = rows.select(
        *TARGET, F.weekday("ds").alias("weekday"),
        F.rank().over(value_order).alias("r"), F.count(F.lit(1)).over(same).alias("ties"),
    ).withColumn("rank", F.col("r") + (F.col("ties") - 1) / 2.0)
    groups = ranked.groupBy(*TARGET, "weekday").agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.sum("rank").alias("s"),
        F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_part"),
    )
    table = groups.groupBy(*TARGET).agg(
        F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"),
        F.count(F.lit(1)).alias("n_groups"), F.sum("tie_part").alias("tie_sum"),
    )
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    correction = 1 - F.try_divide(F.col("tie_sum"), n * n * n - n)
    return table.select(
        *TARGET, n.cast("bigint").alias("n"), "n_groups",
        F.try_divide(raw, F.nullif(correction, F.lit(0.0))).alias("h_statistic"),
    )


def seasonality_test(panel: DataFrame, on_differences: bool = False) -> DataFrame:
    table = kruskal_wallis(panel, on_differences)
    p = chi_square_tail(F.col("h_statistic"), (F.col("n_groups") - 1).cast("double"))
    return table.withColumn("p_value", p).withColumn(
        "has_within_week_seasonality", F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )


def weekday_groups(panel: DataFrame) -> DataFrame:
    rows = panel.filter(~F.col("is_imputed") & F.col("value").isNotNull())
    return rows.groupBy(*TARGET, F.weekday("ds").alias("weekday"), weekday_name(F.col("ds")).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("std"),
    )


def autocorrelation(rows: DataFrame, max_lag: int = 40) -> DataFrame:
    """Biased autocorrelation to ``max_lag``; ``rows`` from present() or differenced().

    All lags are window offsets of one ordering, summed in one aggregation.
    """
    w = Window.partitionBy(*TARGET).orderBy("i")
    dev = rows.select(*TARGET, "i", (F.col("value") - F.avg("value").over(whole())).alias("d"))
    products = dev.select(
        *TARGET, *[(F.col("d") * F.lag("d", k).over(w)).alias(f"p{k}") for k in range(max_lag + 1)]
    )
    sums = products.groupBy(*TARGET).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(max_lag + 1)])
    each = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"p{k}"), F.nullif(F.col("p0"), F.lit(0.0))).alias("acf"))
        for k in range(max_lag + 1)
    ])
    return sums.select(*TARGET, F.inline(each)).filter(F.col("acf").isNotNull())


def durbin_levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 0..K from autocorrelations of lags 0..K."""
    out = np.ones(acf.size)
    phi = np.zeros(0)
    for k in range(1, acf.size):
        denominator = 1.0 - phi @ acf[1:k] if k > 1 else 1.0
        last = (acf[k] - phi @ acf[k - 1 : 0 : -1]) / denominator if k > 1 else acf[1]
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Yule-Walker (biased) partial autocorrelation; a few dozen numbers per group."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf[TARGET + ["lag"]].assign(pacf=durbin_levinson(pdf["acf"].to_numpy()))

    return acf.groupBy(*TARGET).applyInPandas(solve, "series_id string, metric string, lag int, pacf double")


def decomposition(panel: DataFrame, period: int = 5) -> DataFrame:
    """Classical additive decomposition of the present values, one row per slot."""
    w = Window.partitionBy(*TARGET).orderBy("i")
    half = period // 2
    frame = w.rowsBetween(-half, half)
    trend = F.when(F.count("value").over(frame) == period, F.avg("value").over(frame))
    rows = present(panel).withColumn("trend", trend).withColumn("phase", F.col("i") % period)
    loose = rows.withColumn(
        "phase_mean", F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(*TARGET, "phase"))
    )
    means = rows.groupBy(*TARGET, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("pm"))
    centre = means.groupBy(*TARGET).agg(F.avg("pm").alias("centre"))
    seasonal = F.col("phase_mean") - F.col("centre")
    return loose.join(centre, TARGET).select(
        *TARGET, "pos", "i", "value", "trend", seasonal.alias("seasonal"),
        (F.col("value") - F.col("trend") - seasonal).alias("resid"),
    )


def strengths(parts: DataFrame) -> DataFrame:
    """Seasonal and trend strength, ``max(0, 1 - var(R) / var(X + R))``."""
    def strength(component: str) -> Column:
        whole_var = F.var_pop(F.col(component) + F.col("resid"))
        return F.when(
            whole_var > 0,
            F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("resid"), F.nullif(whole_var, F.lit(0.0)))),
        ).otherwise(F.lit(0.0))

    usable = parts.filter(F.col("resid").isNotNull())
    return usable.groupBy(*TARGET).agg(
        strength("seasonal").alias("seasonal_strength"), strength("trend").alias("trend_strength")
    )


def kpss(rows: DataFrame) -> DataFrame:
    """Trend-form KPSS statistic with data-dependent Newey-West lags.

    The lag count follows from the residuals themselves, so the residuals of a
    series are held as one array (bounded by the calendar) and the lagged products
    are folds over it.
    """
    t = (F.col("i") + 1).cast("double")
    fitted = rows.select(
        *TARGET, "i", "n", "value", t.alias("t"),
        F.regr_slope(F.col("value"), t).over(whole()).alias("b"),
        F.regr_intercept(F.col("value"), t).over(whole()).alias("a"),
    ).select(*TARGET, "i", "n", (F.col("value") - F.col("a") - F.col("b") * F.col("t")).alias("e"))
    running = Window.partitionBy(*TARGET).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = fitted.select(*TARGET, "i", "n", "e", F.sum("e").over(running).alias("s"))
    arrays = walked.groupBy(*TARGET).agg(
        F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("e"),
    )

    def product(lag: Column) -> Column:
        pairs = F.zip_with(
            F.slice("e", lag + 1, F.size("e") - lag), F.slice("e", 1, F.size("e") - lag), lambda x, y: x * y
        )
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    n = F.col("n").cast("double")
    short = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
    first = arrays.select(
        "*", (product(F.lit(0)) / n).alias("g0"),
        F.transform(F.sequence(F.lit(1), short), lambda k: product(k) / (n / 2)).alias("g"),
    )
    s0 = F.col("g0") + F.aggregate("g", F.lit(0.0), lambda acc, v: acc + v)
    s1 = F.aggregate(
        F.transform("g", lambda v, k: v * (k + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    ratio = s1 / s0
    lags = F.least(
        F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0))),
        F.col("n") - 1,
    ).cast("int")
    sized = first.select(*TARGET, "n", "ss", "e", "g0", lags.alias("lags"))
    weighted = F.aggregate(
        F.transform(
            F.when(F.col("lags") > 0, F.sequence(F.lit(1), F.col("lags"))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda k: (1 - k / (F.col("lags") + 1.0)) * product(k),
        ),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    s_hat = F.col("g0") + 2 * weighted / n
    return sized.filter(F.col("g0") > 0).select(
        *TARGET, "n", "lags", (F.col("ss") / (n * n) / s_hat).alias("kpss_statistic")
    ).withColumn(
        "kpss_conclusion",
        F.when(F.col("kpss_statistic") < KPSS_5PCT, F.lit("stationary")).otherwise(F.lit("non-stationary")),
    )


def adf_statistic(y: np.ndarray, lags: int) -> float:
    """t statistic of the lagged level in a regression with constant and lagged differences."""
    dy = np.diff(y)
    target = dy[lags:]
    columns = [y[lags:-1]] + [dy[lags - k : dy.size - k] for k in range(1, lags + 1)] + [np.ones(target.size)]
    x = np.column_stack(columns)
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ beta
    sigma2 = resid @ resid / (target.size - x.shape[1])
    return float(beta[0] / np.sqrt(sigma2 * np.linalg.pinv(x.T @ x)[0, 0]))


def adf(rows: DataFrame, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a fixed lag order (Schwert's rule by default)."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("i")["value"].to_numpy(dtype=float)
        order = lags if lags is not None else int(np.ceil(12.0 * (y.size / 100.0) ** 0.25))
        order = max(0, min(order, y.size // 2 - 3))
        usable = y.size > 8 and np.ptp(y) > 0
        return pd.DataFrame({
            "series_id": [pdf["series_id"].iloc[0]], "metric": [pdf["metric"].iloc[0]],
            "n": [y.size], "lags": [order], "adf_statistic": [adf_statistic(y, order) if usable else None],
        })

    made = rows.groupBy(*TARGET).applyInPandas(
        solve, "series_id string, metric string, n bigint, lags int, adf_statistic double"
    )
    return made.withColumn(
        "adf_conclusion",
        F.when(F.col("adf_statistic") < ADF_5PCT, F.lit("stationary")).otherwise(F.lit("non-stationary")),
    )


def joint_stationarity(rows: DataFrame) -> DataFrame:
    """Both tests side by side with the joint reading."""
    a, k = F.col("adf_conclusion") == "stationary", F.col("kpss_conclusion") == "stationary"
    both = adf(rows).withColumnRenamed("lags", "adf_lags").join(
        kpss(rows).withColumnRenamed("lags", "kpss_lags").drop("n"), TARGET
    )
    return both.withColumn(
        "joint_conclusion",
        F.when(a & k, F.lit("stationary")).when(~a & ~k, F.lit("non-stationary"))
        .when(a, F.lit("trend-stationary")).otherwise(F.lit("inconclusive")),
    )


def correlations(master: DataFrame, engine: Engine, form: str = "levels", width: int = 30) -> DataFrame:
    """Pairwise correlation of all measures over the really observed slots.

    ``form``: levels, differences (between consecutive observed slots) or detrended
    (minus the trailing mean).
    """
    w = Window.partitionBy("series_id").orderBy("pos")
    frame = w.rowsBetween(-(width - 1), Window.currentRow)
    names = engine.measure_names

    def shaped(c: str) -> Column:
        v = F.col(c).cast("double")
        if form == "levels":
            return v
        if form == "differences":
            return v - F.lag(v).over(w)
        if form == "detrended":
            return v - F.avg(v).over(frame)
        raise ValueError(f"unknown form {form!r}")

    rows = master.filter(~F.col("is_imputed")).select("series_id", *[shaped(c).alias(c) for c in names])
    pairs = [(a, b) for a in names for b in names]

    table = rows.groupBy("series_id").agg(
        *[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    each = F.array(*[
        F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])
    return table.select("series_id", F.inline(each))
