import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import ArimaSpec, Engine, SmoothingSpec
from tidemark.operators import smoothing as S, statistical as M
from tests.helpers import panel, smoothing_forecast, smoothing_states

WAVE = np.array([5.0, -3.0, 0.0, 2.0, -4.0])


def requests(spark, cutoffs, leads, start=0, metric="load"):
    rows = [("s", metric, start, c, h) for c in cutoffs for h in leads]
    return spark.createDataFrame(
        rows, "series_id string, metric string, train_start_pos int, train_cutoff_pos int, effective_lead int"
    )


def fitted(table):
    return {(r.train_cutoff_pos, r.effective_lead): r for r in table.collect()}


def test_smoothing_recovers_a_noise_free_season(spark):
    y = 100 + np.tile(WAVE, 30)
    engine = Engine(season=5, smoothing={"load": SmoothingSpec(seasonal=True)})
    got = fitted(S.smoothing_forecasts(panel(spark, y), requests(spark, [99, 119], [1, 7, 14]), engine.smoothing, engine))
    for (cutoff, lead), row in got.items():
        assert row.y_pred == pytest.approx(100 + WAVE[(cutoff + lead) % 5], abs=1e-6) and not row.fit_failed
        assert row.y_pred_lo <= row.y_pred <= row.y_pred_hi


def test_one_pass_equals_a_separate_fit_per_cutoff():
    y = np.random.default_rng(1).normal(size=80).cumsum()
    spec = SmoothingSpec(trend=True, damped=True, seasonal=True)
    together = smoothing_states(y, spec, 5, {40, 60, 80})
    for n in (40, 60, 80):
        alone = smoothing_states(y[:n], spec, 5, {n})[n]
        assert smoothing_forecast(together[n], n, 7, spec) == pytest.approx(smoothing_forecast(alone, n, 7, spec))


@pytest.mark.parametrize("spec", [
    SmoothingSpec(), SmoothingSpec(seasonal=True), SmoothingSpec(trend=True), SmoothingSpec(trend=True, damped=True, seasonal=True),
])
def test_folded_recursion_equals_the_loop(spark, spec):
    rng = np.random.default_rng(3)
    y = [None if rng.random() < 0.05 else float(v) for v in np.round(50 + rng.normal(size=90).cumsum(), 2)]
    engine = Engine(season=5, smoothing={"load": spec})
    cutoffs, leads = [30, 31, 57, 89], [1, 2, 7, 14]
    asked = requests(spark, cutoffs, leads).unionByName(requests(spark, cutoffs, leads, start=12))
    rows = S.smoothing_forecasts(panel(spark, y), asked, engine.smoothing, engine).collect()
    assert len(rows) == 2 * len(cutoffs) * len(leads)
    for r in rows:
        seen = np.array([v for v in y[r.train_start_pos : r.train_cutoff_pos + 1] if v is not None])
        state = smoothing_states(seen, spec, 5, {len(seen)}).get(len(seen))
        if len(seen) < S.smoothing_minimum(spec, 5):
            assert r.fit_failed and r.y_pred is None
            continue
        want = smoothing_forecast(state, len(seen), r.effective_lead, spec)
        assert (r.y_pred, r.y_pred_lo, r.y_pred_hi) == pytest.approx(want, rel=1e-9) and not r.fit_failed and not r.forecast_failed


def test_a_stored_fit_answers_like_a_refit(spark):
    y = np.random.default_rng(8).normal(size=100).cumsum() + 40
    engine = Engine(season=5, smoothing={"load": SmoothingSpec(trend=True, damped=True, seasonal=True)})
    table = S.with_counts(requests(spark, [60, 80], [1]), panel(spark, y))
    fits = S.smoothing_fits(panel(spark, y), table, engine.smoothing, engine)
    later = S.with_counts(requests(spark, [60, 80], [3, 14]), panel(spark, y))
    stored = fitted(S.forecasts_from(fits, later, engine.smoothing, engine))
    fresh = fitted(S.smoothing_forecasts(panel(spark, y), later.drop("n_finite"), engine.smoothing, engine))
    assert {k: r.y_pred for k, r in stored.items()} == {k: r.y_pred for k, r in fresh.items()} and len(stored) == 4


def test_a_forecast_that_is_not_finite_fails_alone(spark):
    y = 100 + np.tile(WAVE, 20)
    engine = Engine(season=5, smoothing={"load": SmoothingSpec(seasonal=True)})
    table = S.with_counts(requests(spark, [60, 80], [1]), panel(spark, y))
    fits = S.smoothing_fits(panel(spark, y), table, engine.smoothing, engine)
    broken = fits.withColumn("level", F.when(F.col("n_finite") == 61, float("inf")).otherwise(F.col("level")))
    got = fitted(S.forecasts_from(broken, table, engine.smoothing, engine))
    assert got[60, 1].forecast_failed and not got[60, 1].fit_failed and got[60, 1].y_pred is None and got[60, 1].failure_reason
    assert got[80, 1].y_pred == pytest.approx(100 + WAVE[81 % 5], abs=1e-6) and not got[80, 1].forecast_failed


def test_smoothing_drops_missing_rows_and_abstains_when_short(spark):
    y = [None if i % 9 == 0 else 50.0 for i in range(60)]
    engine = Engine(season=5, smoothing={"load": SmoothingSpec(seasonal=True)})
    got = fitted(S.smoothing_forecasts(panel(spark, y), requests(spark, [12, 59], [1]), engine.smoothing, engine))
    assert got[59, 1].y_pred == pytest.approx(50.0)
    short = got[12, 1]
    assert short.fit_failed and short.y_pred is None and "insufficient" in short.failure_reason


def test_arima_follows_trend_and_season(spark):
    y = 3.0 * np.arange(150) + np.tile(WAVE, 30)
    engine = Engine(season=5, arima={"load": ArimaSpec()})
    got = fitted(M.arima_fits(panel(spark, y), requests(spark, [99, 129], [1, 7, 14]), engine.arima, engine))
    for (cutoff, lead), row in got.items():
        assert row.y_pred == pytest.approx(3.0 * (cutoff + lead) + WAVE[(cutoff + lead) % 5], abs=1e-6)


def test_arima_estimates_a_moving_average():
    e = np.random.default_rng(2).normal(size=3000)
    y = np.cumsum(e[1:] - 0.6 * e[:-1])
    spec = ArimaSpec(order=(0, 1, 1), seasonal_order=(0, 0, 0))
    point, half = M.arima_forecast(y, [1], spec, 5)[1]
    assert half == pytest.approx(1.96, rel=0.06)
    weights = 0.4 * 0.6 ** np.arange(200)
    assert point == pytest.approx(float(weights @ y[::-1][:200]), abs=0.25)


def test_no_better_parameters_near_those_of_a_fit():
    rng = np.random.default_rng(6)
    y = rng.normal(size=260).cumsum() + np.tile(WAVE, 52) + rng.normal(size=260)
    y[[30, 31, 90]] = np.nan
    for spec in (ArimaSpec(order=(2, 1, 2)), ArimaSpec(order=(0, 1, 2)), ArimaSpec(order=(1, 0, 0), seasonal_order=(1, 1, 0))):
        held = M._Folds(y, [60, 61, 150, 260], spec, 5)
        u, sse, e, status = M.arima_parameters(held)
        assert set(status) <= {M.CONVERGED, M.BOUNDARY} and M.CONVERGED in status
        assert ((e * held.fit) ** 2).sum(0) == pytest.approx(sse)
        for f in np.flatnonzero(status == M.CONVERGED):
            for k in range(held.count):
                for step in (0.02, -0.02, 0.2, -0.2):
                    near = u[f].copy()
                    near[k] += step
                    found = held.innovations(near[None, None, :], np.array([f]))[:, 0, 0] * held.fit[:, f]
                    assert found @ found >= sse[f] * (1 - 1e-6)


def test_innovations_look_back_over_the_whole_history():
    # a moving average near the unit circle remembers what a cut-off filter would drop
    rng = np.random.default_rng(7)
    held = M._Folds(rng.normal(size=900).cumsum(), [900], ArimaSpec(order=(0, 1, 1), seasonal_order=(0, 0, 0)), 7)
    e = held.innovations(np.arctanh(np.array([[[-0.999]]])), np.array([0]))[:, 0, 0]
    want = np.zeros(len(e))
    for t, w in enumerate(held.w[:, 0]):
        want[t] = w + (0.999 * want[t - 1] if t else 0.0)
    assert e == pytest.approx(want)


def test_folds_fitted_together_equal_folds_fitted_alone():
    y = np.random.default_rng(9).normal(size=200).cumsum()
    spec = ArimaSpec(order=(1, 1, 1))
    together = M.arima_paths(M._Folds(y, [80, 120, 200], spec, 5), [[1, 7]] * 3)
    for fit, n in zip(together, (80, 120, 200)):
        alone = M.arima_forecast(y[:n], [1, 7], spec, 5)
        for h in (1, 7):
            assert fit["made"][h] == pytest.approx(alone[h], rel=1e-4)


def test_arima_bridges_gaps_and_abstains_when_short(spark):
    y = 100 + np.tile(WAVE, 30)
    holes = [None if i in (20, 21, 50, 77) else float(v) for i, v in enumerate(y)]
    engine = Engine(season=5, arima={"load": ArimaSpec()})
    got = fitted(M.arima_fits(panel(spark, holes), requests(spark, [10, 149], [3]), engine.arima, engine))
    assert got[149, 3].y_pred == pytest.approx(100 + WAVE[152 % 5], abs=1.0)
    assert got[10, 3].fit_failed and got[10, 3].y_pred is None


def test_polynomials_stay_stable():
    rng = np.random.default_rng(0)
    for _ in range(50):
        c = M.stable(rng.normal(scale=3, size=3))
        assert (np.abs(np.roots(np.r_[1.0, c])) < 1 + 1e-9).all()


def test_later_rows_do_not_change_a_fit(spark):
    y = np.random.default_rng(4).normal(size=120).cumsum() + 50
    engine = Engine()
    ask = requests(spark, [89], [1, 7])
    for fit, specs in ((S.smoothing_forecasts, engine.smoothing), (M.arima_fits, engine.arima)):
        a = fitted(fit(panel(spark, y[:90]), ask, specs, engine))
        b = fitted(fit(panel(spark, np.r_[y[:90], 9999 * np.ones(30)]), ask, specs, engine))
        assert [a[k].y_pred for k in sorted(a)] == [b[k].y_pred for k in sorted(b)]


def test_requests_of_other_metrics_are_left_alone(spark):
    engine = Engine(season=5, smoothing={"load": SmoothingSpec()})
    asked = requests(spark, [50], [1], metric="intake")
    assert S.smoothing_forecasts(panel(spark, range(60)), asked, engine.smoothing, engine).filter(F.lit(True)).count() == 0
