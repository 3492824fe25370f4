import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import intervals as X
from tidemark.operators import intervals, warning
from tests.helpers import ENGINE, panel

POOL = "series_id string, metric string, horizon int, model string, residual double"


def with_interval(spark, point, residuals, floor=None):
    pool = spark.createDataFrame([("s", "load", 1, "naive", float(r)) for r in residuals], POOL)
    row = spark.createDataFrame([("s", "load", 1, "naive", point)], POOL.replace("residual", "point_forecast"))
    return intervals.with_interval(row, intervals.pool_quantiles(pool, ENGINE), ENGINE, floor).first()


def test_interval_is_the_linear_quantiles(spark):
    r = np.arange(-50, 51)
    got = with_interval(spark, 100.0, r)
    assert got.lower == pytest.approx(100 + np.percentile(r, 2.5)) and got.upper == pytest.approx(100 + np.percentile(r, 97.5))


def test_thin_pool_is_withheld_and_floor_clips(spark):
    thin = with_interval(spark, 5.0, range(9))
    assert not thin.interval_sufficient and thin.lower is None and thin.interval_note == "few_residuals:9"
    assert with_interval(spark, 5.0, range(10)).interval_sufficient
    clipped = with_interval(spark, 5.0, range(-40, 41), floor=0.0)
    assert clipped.lower == 0 and clipped.lower_unclipped < 0 and clipped.clipped_at_floor


def test_wilson_and_coverage(spark):
    low, high = X.wilson(F.lit(12), F.lit(12))
    got = spark.range(1).select(low.alias("lo"), high.alias("hi")).first()
    assert got.hi == 1.0 and 0 < got.lo < 1
    rows = spark.createDataFrame([("s", float(y), 0.0, 10.0) for y in (1, 2, 3, 100)], "series_id string, y_true double, lower double, upper double")
    cover = intervals.coverage(rows, ["series_id"], ENGINE).first()
    assert (cover.n, cover.n_covered, cover.empirical_coverage) == (4, 3, 0.75)


def test_leave_one_out_against_brute_force(spark):
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 11, 40):
        r = rng.integers(-20, 20, size=n).astype(float)
        pool = spark.createDataFrame([("s", "load", 1, "naive", float(x)) for x in r], POOL)
        got = intervals.leave_one_out_counts(pool, ENGINE).collect()
        if n < 3:
            assert got == []
            continue
        covered = sum(
            np.percentile(np.delete(r, i), 2.5) <= r[i] <= np.percentile(np.delete(r, i), 97.5) for i in range(n)
        )
        assert (got[0].n, got[0].n_covered) == (n, covered)


@pytest.mark.parametrize(
    "a,b,cov,r,variance,form",
    [(10.0, 20.0, 4.0, 0.9, 22.0, "full_covariance"), (10.0, 20.0, 1.0, 0.1, 30.0, "independence"),
     (10.0, 20.0, 4.0, None, 22.0, "full_covariance"), (1.0, 1.0, 100.0, 0.99, 0.0, "full_covariance")],
)
def test_difference_variance(spark, a, b, cov, r, variance, form):
    row = spark.createDataFrame([(a, b, cov, r)], "a double, b double, c double, r double")
    v, f = X.difference_variance(F.col("a"), F.col("b"), F.col("c"), F.col("r"), 0.2)
    got = row.select(v.alias("v"), f.alias("f")).first()
    assert (got.v, got.f) == (pytest.approx(variance), form)


def threshold(spark, values, origin, gaps=(), window=60):
    e = ENGINE.with_(warn_window=window)
    return warning.thresholds(panel(spark, values, gaps), e).filter(F.col("pos") == origin).first().threshold


def test_threshold_is_trailing_and_observed_only(spark):
    values = [1000] * 100 + [1] * 100
    assert threshold(spark, values, 199, window=50) == 1
    assert threshold(spark, values, 99, window=50) == 1000
    assert threshold(spark, [10] * 50 + [9999] * 10, 59, gaps=range(50, 60)) == 10
    a = threshold(spark, list(range(100)), 80)
    assert a == threshold(spark, list(range(81)) + [10**6] * 50, 80) == pytest.approx(np.percentile(np.arange(21, 81), 90))


def classify(spark, forecasts, limit=100.0):
    rows = spark.createDataFrame([("s", h, float(v), limit) for h, v in forecasts.items()], "series_id string, horizon int, forecast double, threshold double")
    return warning.classify(rows, ["series_id"], ENGINE).first()


def test_tiers(spark):
    got = classify(spark, {1: 50, 7: 150, 14: 200})
    assert (got.fired_horizons, got.highest_tier, got.earliest_tier) == ("7,14", "Warning", "Watch")
    every = classify(spark, {1: 150, 7: 150, 14: 150})
    assert (every.highest_tier, every.earliest_tier) == ("Alert", "Watch")
    assert classify(spark, {1: 50, 7: 50, 14: 150}).highest_tier == "Watch"
    assert not classify(spark, {1: 150}, None).fired


@pytest.mark.parametrize("forecast,limit,label", [(150.0, 100.0, "High"), (95.0, 100.0, "Elevated"), (10.0, 100.0, "Normal"), (None, 100.0, "Normal"), (150.0, None, "Normal")])
def test_capacity_labels(spark, forecast, limit, label):
    row = spark.createDataFrame([(forecast, limit)], "f double, t double")
    assert row.select(X.capacity_label(F.col("f"), F.col("t"), 0.9).alias("v")).first().v == label


def test_first_crossing_counts_observed_values_only(spark):
    values = [10] * 60 + [99, 10, 99] + [10] * 20
    got = warning.watch(panel(spark, values, gaps=[60]), ENGINE).filter("pos = 59").first()
    assert (got.threshold, got.crossing_offset) == (10, 3)
    none = warning.watch(panel(spark, [10] * 75 + [99]), ENGINE).filter("pos = 59").first()
    assert none.crossing_offset is None


def test_summary_rates(spark):
    rows = [("true_positive", 3), ("true_positive", 5), ("false_positive", None), ("false_negative", None), ("true_negative", None), (None, None)]
    table = spark.createDataFrame([("s", o, l) for o, l in rows], "series_id string, outcome string, lead_time int")
    got = warning.summarise(table, ["series_id"]).first()
    assert (got.n_origins, got.n_fired, got.median_surge_lead_time) == (5, 3, 4.0)
    assert (got.false_positive_rate, got.false_negative_rate) == (pytest.approx(1 / 3), 0.5)
