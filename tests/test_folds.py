import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, folds, harness
from tidemark.operators.baselines import baseline_forecasts
from tidemark.operators.cleaning import long_panel
from tests.helpers import ENGINE, bounds, master, panel


def grid(spark, m, b, portion="development"):
    return {r.fold_id: r for r in folds.origin_folds(m, b, ENGINE, portion).collect()}


def test_holdout_is_counted_in_real_slots(spark):
    e = ENGINE.with_(holdout_real=10)
    assert calendar.series_bounds(master(spark, 100), e).first().holdout_start_pos == 90
    assert calendar.series_bounds(master(spark, 100, gaps=[95]), e).first().holdout_start_pos == 89
    too_few = calendar.series_bounds(master(spark, 5), e)
    assert calendar.require_boundaries(too_few).first().too_few_real_slots


def test_fold_grid(spark):
    got = grid(spark, master(spark, 200), bounds(spark, 200, 0, dev_end=150))
    origins = sorted(r.origin_pos for r in got.values())
    assert origins[0] == 49 and set(b - a for a, b in zip(origins, origins[1:])) == {10}
    assert max(t.test_pos for r in got.values() for t in r.tests) <= 150


def test_gap_flags(spark):
    def first_two(gap):
        got = grid(spark, master(spark, 200, gaps=[gap]), bounds(spark, 200, 0, dev_end=150))
        return got[0], got[1]

    on, _ = first_two(49)
    assert on.origin_is_imputed and on.gap_contaminated and on.train_cutoff_pos == 48
    assert [t.effective_lead for t in on.tests] == [2, 8, 15]
    beside, _ = first_two(50)
    assert not beside.origin_is_imputed and beside.origin_adjacent_to_gap and beside.gap_contaminated
    _, far = first_two(73)
    assert [t.test_is_imputed for t in far.tests] == [False, False, True] and not far.gap_contaminated


def window(spark, origin, cutoff=540, missing=()):
    values = [None if i in missing else i for i in range(1000)]
    state = folds.training_state(panel(spark, values), bounds(spark, 1000, cutoff), ENGINE)
    fold = spark.createDataFrame(
        [("s", 0, origin, origin, cutoff)],
        "series_id string, fold_id int, origin_pos int, train_cutoff_pos int, cutoff_pos int",
    )
    return folds.training_windows(fold, state, ENGINE).filter("window_rule = 'capped'").first()


@pytest.mark.parametrize(
    "origin,start,fallback,flips",
    [(300, 0, False, False), (700, 540, False, False), (560, 0, True, False), (599, 540, False, True),
     (598, 0, True, False), (602, 540, False, True), (625, 540, False, False)],
)
def test_training_window_boundaries(spark, origin, start, fallback, flips):
    got = window(spark, origin)
    assert (got.train_start_pos, got.fallback_applied, got.flips_at_upper_floor) == (start, fallback, flips)


def test_missing_rows_do_not_count_as_usable(spark):
    assert window(spark, 609, missing=set(range(545, 560))).fallback_applied


def test_unknown_rule_is_rejected(spark):
    with pytest.raises(ValueError, match="unknown window rule"):
        folds.training_windows(None, None, ENGINE.with_(rules=("full", "halved")))


def forecast(spark, values, leads, start=0, **changes):
    e = ENGINE.with_(**changes)
    n = len(values)
    state = folds.training_state(panel(spark, values), bounds(spark, n, 0), e)
    rows = state.filter(F.col("train_cutoff_pos") == n - 1).select(
        "*", F.lit(start).alias("train_start_pos"), F.explode(F.array(*[F.lit(h) for h in leads])).alias("effective_lead")
    )
    made = baseline_forecasts(rows, e).collect()
    return {(r.model, r.effective_lead): r.y_pred for r in made}


def test_naive_takes_the_last_present_value(spark):
    got = forecast(spark, [10, 20, None, 40], [1, 7])
    assert got["naive", 1] == got["naive", 7] == 40
    assert forecast(spark, [10, 20, None], [1])["naive", 1] == 20
    assert forecast(spark, [10, None, None], [1], start=1)["naive", 1] is None


def test_seasonal_naive_index(spark):
    got = forecast(spark, [1, 2, 3, 4, 5, 11, 12, 13, 14, 15], [1, 2, 5, 6, 7])
    assert [got["seasonal_naive", h] for h in (1, 2, 5, 6, 7)] == [11, 12, 15, 11, 12]
    assert forecast(spark, [1, 2, 3], [1])["seasonal_naive", 1] is None
    assert forecast(spark, [1, 2, 3, 4, 5, None, 12], [4])["seasonal_naive", 4] is None


def test_moving_average_skips_gaps_and_clips_to_the_window(spark):
    assert forecast(spark, [10, 20, 30, 40, 50], [1], average_window=3)["moving_average", 1] == 40
    assert forecast(spark, [10, None, 30], [1], average_window=3)["moving_average", 1] == 20
    assert forecast(spark, [10, 20, 30], [1], start=1)["moving_average", 1] == 25
    assert forecast(spark, [None, None], [1])["moving_average", 1] is None


def run(spark, m, b):
    p = long_panel(m, ENGINE, ENGINE.targets)
    state = folds.training_state(p, b, ENGINE)
    return harness.walk_forward(
        folds.origin_folds(m, b, ENGINE), state, p, ENGINE, ("naive", "seasonal_naive", "moving_average", "exponential_smoothing")
    )


def test_later_rows_never_change_an_earlier_fold(spark):
    short, long = master(spark, 120), master(spark, 200, load=lambda i: i if i < 120 else 10_000 + i)
    keys = ["metric", "model", "window_rule", "fold_id", "horizon", "y_pred", "mase_scale"]
    a = run(spark, short, bounds(spark, 120, 60)).select(*keys)
    b = run(spark, long, bounds(spark, 200, 60)).filter("test_pos < 120").select(*keys)
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_rules_agree_before_the_cutoff_and_share_the_scale(spark):
    table = run(spark, master(spark, 200, gaps=[49, 73]), bounds(spark, 200, 140))
    wide = table.groupBy("metric", "model", "fold_id", "horizon").agg(
        F.count_distinct("mase_scale").alias("scales"),
        F.min("origin_pos").alias("origin"),
        F.max(F.when(F.col("window_rule") == "full", F.col("y_pred"))).alias("full"),
        F.max(F.when(F.col("window_rule") == "capped", F.col("y_pred"))).alias("capped"),
    )
    assert wide.filter("scales > 1").count() == 0
    assert wide.filter("origin < 140 AND NOT (full <=> capped)").count() == 0


def test_common_support_drops_a_point_for_all_models_or_none(spark):
    table = harness.with_common_support(run(spark, master(spark, 200, gaps=[49, 60, 73]), bounds(spark, 200, 140)))
    mixed = table.groupBy(*harness.POINT).agg(F.count_distinct("common_support").alias("n")).filter("n > 1")
    assert mixed.count() == 0
    assert table.filter("NOT common_support").count() > 0


def test_no_training_window_ends_on_a_gap(spark):
    m, b = master(spark, 200, gaps=[49, 59, 60]), bounds(spark, 200, 140)
    report = folds.leakage_checks(folds.origin_folds(m, b, ENGINE), b, m)
    assert report.filter("NOT passed").count() == 0 and report.count() == 4


def test_unknown_model_is_rejected(spark):
    with pytest.raises(ValueError, match="unknown model"):
        harness.check_models(("naive", "prophet"))
