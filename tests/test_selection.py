import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection
from tests.helpers import ENGINE, prediction_rows

E = ENGINE.with_(resamples=2000)


def pairs(spark, a, b):
    rows = [("s", "load", "capped", i, 1, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(
        rows, "series_id string, metric string, window_rule string, fold_id int, horizon int, error_a double, error_b double"
    )


@pytest.mark.parametrize("draws", ["numpy", "portable"])
def test_bootstrap_separates_constant_errors(spark, draws):
    got = selection.paired_bootstrap(pairs(spark, [10] * 40, [1] * 40), E.with_(draws=draws)).first()
    assert got.mean_difference == 9 and got.ci_low > 0 and got.distinguishable and not got.practically_equivalent
    assert selection.paired_bootstrap(pairs(spark, [], []), E).count() == 0


def test_numpy_draws_are_numpys(spark):
    d = np.random.default_rng(1).normal(size=15)
    got = selection.paired_bootstrap(pairs(spark, d, np.zeros(15)), ENGINE).first()
    idx = np.random.default_rng(42).integers(0, 15, size=(10_000, 15))
    low, high = np.percentile(d[idx].mean(axis=1), [2.5, 97.5])
    assert (got.ci_low, got.ci_high) == (pytest.approx(low), pytest.approx(high))


@pytest.mark.parametrize("mae,expected", [(8.0, True), (30.0, False), (10.0, False), (None, False)])
def test_gate_is_strict(spark, mae, expected):
    row = spark.createDataFrame([(mae, 10.0, 50.0)], "m double, a double, b double")
    assert row.select(selection.passes_gate(F.col("m"), [F.col("a"), F.col("b")]).alias("v")).first().v is expected


def decide(spark, models, actuals, forecasts):
    return selection.select_champions(prediction_rows(spark, models, actuals, forecasts), E).first()


def test_exact_baseline_wins_when_nothing_clears_the_gate(spark):
    y = [10.0] * 20
    got = decide(spark, ["naive", "seasonal_naive", "moving_average", "sarima"], y, [y, [12.0] * 20, [13.0] * 20, [15.0] * 20])
    assert got.champion == "naive" and got.gate_cleared_by == [] and got.numerical_leader is None
    assert got.reason == selection.BASELINE_WINS


def test_clearly_better_candidate_wins(spark):
    y = np.linspace(10, 30, 30)
    jitter = np.tile([-1.0, 1.0], 15)
    got = decide(
        spark, ["naive", "seasonal_naive", "moving_average", "sarima"], y,
        [y + 12 * jitter, y + 13 * jitter, y + 14 * jitter, y + 0.5 * jitter],
    )
    assert got.champion == "sarima" and got.gate_cleared_by == ["sarima"] and got.champion_mae == pytest.approx(0.5)


def test_simpler_model_is_preferred_among_the_tied(spark):
    rng = np.random.default_rng(3)
    y = np.full(30, 100.0)
    noise = rng.normal(size=30)
    got = decide(
        spark, ["naive", "seasonal_naive", "random_forest", "sarima"], y,
        [y + 9 * noise, y + 9 * noise, y + noise, y + 1.01 * rng.normal(size=30)],
    )
    assert got.champion == "sarima" and set(got.tied_with_best) == {"sarima", "random_forest"}


def test_bias_only_chooses_among_the_tied(spark):
    jitter = np.tile([-1.0, 1.0], 15)
    y = np.full(30, 100.0)
    # equally large errors: one always above, the other balanced but more complex
    got = decide(
        spark, ["naive", "seasonal_naive", "sarima", "random_forest"], y, [y + 9, y + 9, y + 1, y + jitter],
    )
    assert got.champion == "random_forest" and got.bias_screened_out == ["sarima"]
    alone = decide(spark, ["naive", "seasonal_naive", "sarima"], y, [y + 9, y + 9, y + 1])
    assert alone.champion == "sarima" and alone.bias_screened_out == ["sarima"]


def test_unknown_model_ranks_last(spark):
    row = spark.createDataFrame([("naive",), ("ensemble",), ("novel",)], "m string")
    assert [r.v for r in row.select(selection.complexity_rank(F.col("m")).alias("v")).collect()] == [0, 7, 8]


def test_stability(spark):
    rows = prediction_rows(spark, ["naive"], [0.0] * 5, [[1.0, 2.0, 3.0, 4.0, 100.0]])
    got = selection.stability_diagnostics(rows, ["series_id", "model"]).first()
    assert (got.error_median, got.error_iqr) == (3.0, 2.0)
    assert got.tail_ratio == pytest.approx(np.percentile([1, 2, 3, 4, 100], 90) / 3)
