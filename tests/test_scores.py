import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.scoring import metrics_matrix
from tidemark.operators.folds import training_state
from tests.helpers import ENGINE, bounds, panel

def one(spark, expr, y, f, scales=None):
    rows = list(zip(y, f, scales or [None] * len(y)))
    return spark.createDataFrame(rows, "y double, f double, c double").agg(expr(F.col("y"), F.col("f"), F.col("c")).alias("v")).first()["v"]


def test_hand_computed_errors(spark):
    assert one(spark, lambda y, f, c: S.mae(y, f), [10.0, 20.0, 30.0], [12.0, 18.0, 34.0]) == pytest.approx(8 / 3)
    assert one(spark, lambda y, f, c: S.rmse(y, f), [10.0, 20.0], [13.0, 24.0]) == pytest.approx(math.sqrt(12.5))
    assert one(spark, lambda y, f, c: S.mape(y, f), [0.0, 10.0], [5.0, 12.0]) == pytest.approx(20.0)
    assert one(spark, lambda y, f, c: S.zero_actuals(y, f), [0.0, 10.0], [5.0, 12.0]) == 1
    assert one(spark, lambda y, f, c: S.mean_error(y, f), [10.0, 20.0], [13.0, None]) == pytest.approx(3.0)


@pytest.mark.parametrize(
    "y,f,expected", [([10.0], [12.0], 200 / 11), ([0.0], [50.0], 200.0), ([0.0, 10.0], [0.0, 10.0], 0.0)]
)
def test_smape_convention(spark, y, f, expected):
    assert one(spark, lambda y, f, c: S.smape(y, f), y, f) == pytest.approx(expected)


def test_pooled_mase_uses_each_folds_scale(spark):
    y, f = [100.0, 100.0], [110.0, 110.0]
    assert one(spark, lambda y, f, c: S.pooled_mase(y, f, c), y, f, [10.0, 100.0]) == pytest.approx(0.55)
    assert one(spark, lambda y, f, c: S.pooled_mase(y, f, c), y, f, [10.0, 0.0]) == pytest.approx(1.0)


def test_accounting(spark):
    rows = list(zip([10.0, 0.0, None, 40.0], [12.0, 1.0, 30.0, None], [4.0] * 4))
    got = spark.createDataFrame(rows, "y double, f double, c double").agg(*S.measures(F.col("y"), F.col("f"), F.col("c"))).first()
    assert (got.n_total, got.n_missing_actual, got.n_missing_pred, got.n_scored) == (4, 1, 1, 2)
    assert got.n_zero_actual_excluded_from_mape == 1
    assert got.MAE == pytest.approx(1.5) and got.MASE == pytest.approx(0.375)


@pytest.mark.parametrize(
    "values,m,expected",
    [([1, 2, 3, 4, 5], 2, 2.0), ([1, 2, None, 4, 5], 2, 2.0), ([1, 2, 3], 5, None), ([7] * 6, 2, None)],
)
def test_error_scale(spark, values, m, expected):
    n = len(values)
    state = training_state(panel(spark, values), bounds(spark, n, 0), ENGINE.with_(season=m))
    assert state.filter(F.col("train_cutoff_pos") == n - 1).first().mase_scale == expected


def test_interpolated_actuals_are_counted_not_scored(spark):
    rows = [("s", 1, True, 10.0, 12.0, False), ("s", 2, False, 11.0, 99.0, True)]
    table = spark.createDataFrame(
        rows, "series_id string, fold_id int, y_true_is_observed boolean, y_true double, y_pred double, gap_contaminated boolean"
    ).withColumn("mase_scale", F.lit(1.0))
    got = metrics_matrix(table, ["series_id"]).first()
    assert (got.n_scored, got.n_total, got.n_excluded_interpolated_actual) == (1, 1, 1)
    assert (got.MAE, got.n_folds, got.n_gap_contaminated_folds) == (2.0, 2, 1)
    assert metrics_matrix(table, ["series_id"], only_observed=False).first().n_scored == 2


def test_correlation_of_a_constant_is_null(spark):
    assert one(spark, lambda y, f, c: S.correlation(y, f), [1.0, 2.0, 3.0], [5.0, 5.0, 5.0]) is None
    assert one(spark, lambda y, f, c: S.correlation(y, f), [1.0, 2.0, 4.0, None], [2.0, 4.0, 8.0, 1.0]) == pytest.approx(1.0)
    assert one(spark, lambda y, f, c: S.correlation(y, f), [1.0], [2.0]) is None
