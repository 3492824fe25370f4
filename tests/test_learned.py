"""Tree growth against hand-computed trees; fits and forecasts of the pooled panel."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import trees
from tidemark.operators import learned
from tidemark.session import ship_package
from tidemark.sources import raw_text
from tests.helpers import ENGINE, START

ENGINE = ENGINE.with_(trees=3, boosting_rounds=2, refit_days=91, targets=("load",))


def test_one_boosted_tree_by_hand():
    x = np.array([[1.0], [2.0], [3.0], [4.0], [5.0], [6.0]])
    y = np.array([1.0, 1.0, 1.0, 7.0, 7.0, 13.0])
    made = trees.gradient_boosting(x, y, 1, 1, 1, 0.5, 0)
    # mean 5; the best cut is 3.5: left mean 1, right mean 9
    assert made.base == 5.0 and made.cut[0, 0] == 3.5 and made.predictor[0].tolist() == [0, -1, -1]
    assert made.predict(x).tolist() == [3.0, 3.0, 3.0, 7.0, 7.0, 7.0]
    two = trees.gradient_boosting(x, y, 2, 1, 1, 0.5, 0)
    # residuals -2 -2 -2 0 0 6: the best cut is 5.5
    assert two.cut[1, 0] == 5.5 and two.predict(x)[-1] == pytest.approx(7.0 + 0.5 * 6.0)


def test_a_deep_tree_by_hand():
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]] * 5)
    y = np.array([1.0, 2.0, 10.0, 40.0] * 5)
    made = trees.gradient_boosting(x, y, 1, 2, 5, 1.0, 0)
    assert made.predict(x[:4]).tolist() == pytest.approx([1.0, 2.0, 10.0, 40.0])
    assert made.predictor[0, :3].tolist() == [0, 1, 1] and made.importance.sum() == pytest.approx(1.0)
    # leaves keep five rows: nothing can be cut with six
    assert trees.gradient_boosting(x[:6], y[:6], 1, 2, 5, 1.0, 0).predict(x[:1])[0] == pytest.approx(y[:6].mean())


def test_missing_values_stand_below_all_others():
    x = np.array([[np.nan], [np.nan], [1.0], [2.0]])
    made = trees.gradient_boosting(x, np.array([5.0, 5.0, 0.0, 0.0]), 1, 1, 1, 1.0, 0)
    assert made.predict(np.array([[np.nan], [1.5], [-9.0]])).tolist() == [5.0, 0.0, 0.0]


def test_forest_averages_trees_that_are_exact_searches():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = np.where(x[:, 2] > 0.3, 10.0, 0.0) + 0.01 * rng.normal(size=300)
    made = trees.random_forest(x, y, 40, 8, 5, 1)
    assert made.importance.argmax() == 2 and np.abs(made.predict(x) - y).mean() < 1.0
    again = trees.Trees.load(made.dump())
    assert (again.predict(x) == made.predict(x)).all()
    # a gap in a forecast's row is filled by the median
    row = x[:1].copy()
    row[0, 2] = np.nan
    filled = x[:1].copy()
    filled[0, 2] = np.median(x[:, 2])
    assert made.predict(row) == made.predict(filled)
    # every split leaves five rows on each side
    codes, cuts = trees.binned(x)
    *_, leaf = trees.grow(codes, cuts, np.ones((1, 300)), y[None, :], 8, 5, 6, rng)
    assert np.bincount(leaf[0])[np.unique(leaf[0])].min() >= 5


def asked(spark, ends, every=True):
    """Folds at 49, 59, ... of series that begin on the same day, or the last one only."""
    rows = []
    for s, n in ends.items():
        grid = range(49, n - 14, 10)
        for pos in grid if every else grid[-1:]:
            rows += [(s, "load", "full", (pos - 49) // 10, START + timedelta(days=pos), h, 0, pos, h) for h in (1, 7)]
    return spark.createDataFrame(
        rows, "series_id string, metric string, window_rule string, fold_id int, origin_date date, horizon int, "
        "train_start_pos int, train_cutoff_pos int, effective_lead int",
    )


def tables(spark, ends):
    ship_package(spark)
    rows = [(s, i, float(i % 7 + (i % 3)), float(i % 7)) for s, n in ends.items() for i in range(n)]
    features = spark.createDataFrame([(s, p, a, b) for s, p, a, b in rows], "series_id string, pos int, lag_1_load double, lag_7_load double")
    panel = spark.createDataFrame([(s, "load", p, a) for s, p, a, _ in rows], "series_id string, metric string, pos int, value double")
    return features, panel


def test_pooled_pairs_never_hold_later_data(spark):
    ends = {"short": 90, "long": 400}
    features, panel = tables(spark, ends)
    data = learned.pairs(asked(spark, ends), features, panel, ENGINE)
    label = F.date_add(F.lit(START), (F.col("pos") + F.col("lead")).cast("int"))
    assert data.filter(label > F.col("refit_date")).count() == 0
    held = {(r.refit_date, r.series_id) for r in data.select("refit_date", "series_id").distinct().collect()}
    # the short series stays in the pool after its last fold
    assert {s for _, s in held} == set(ends) and max(d for d, s in held if s == "short") == max(d for d, s in held)


def test_appending_future_rows_changes_nothing(spark):
    wanted = asked(spark, {"short": 90, "long": 200})

    def pairs(ends):
        features, panel = tables(spark, ends)
        rows = learned.pairs(wanted, features, panel, ENGINE)
        return sorted((tuple(r) for r in rows.collect()), key=repr)

    assert pairs({"short": 90, "long": 200}) == pairs({"short": 160, "long": 260}) != []


def test_every_fold_is_forecast_by_the_newest_fit_before_it(spark):
    ends = {"a": 300, "b": 200}
    features, panel = tables(spark, ends)
    rows = asked(spark, ends)
    for family in ("random_forest", "gradient_boosting"):
        made, fits = learned.learned_forecasts(rows, features, panel, ENGINE, family)
        got = made.collect()
        assert len(got) == rows.count() and all(r.y_pred is not None and not r.fit_failed and not r.forecast_failed for r in got)
        stored = {(r.refit_date, r.lead): r for r in fits.collect()}
        dates = sorted({d for d, _ in stored})
        assert len(dates) == 3
        for r in got:
            fit = stored[max(d for d in dates if d <= r.origin_date), r.horizon]
            row = np.array([[(r.train_cutoff_pos % 7) + (r.train_cutoff_pos % 3), r.train_cutoff_pos % 7]], float)
            assert r.y_pred == pytest.approx(trees.Trees.load(fit.model).predict(row)[0])
        shares = learned.importances(fits).groupBy("refit_date", "horizon").agg(F.sum("importance").alias("s")).collect()
        assert all(r.s == pytest.approx(1.0) for r in shares)


def test_stored_fits_answer_later_requests(spark):
    ends = {"a": 300}
    features, panel = tables(spark, ends)
    _, fits = learned.learned_forecasts(asked(spark, {"a": 150}), features, panel, ENGINE, "gradient_boosting")
    later = learned.apply_fits(asked(spark, ends, every=False), features, fits, ENGINE).collect()
    assert len(later) == 2 and all(r.y_pred is not None for r in later)


def test_failures_stay_in_their_cell(spark):
    ends = {"tiny": 75, "long": 300}
    features, panel = tables(spark, ends)
    few = ENGINE.with_(min_pairs=45)
    made, fits = learned.learned_forecasts(asked(spark, ends), features, panel, few, "random_forest")
    reasons = {(r.horizon, r.fit_failed, r.failure_reason[:4]) for r in made.collect()}
    # at the first refit date the pool has 49 + 49 pairs less the lead of each
    assert {r.fit_failed for r in fits.collect()} == {False} and reasons == {(1, False, ""), (7, False, "")}
    none = ENGINE.with_(min_pairs=95)
    made, fits = learned.learned_forecasts(asked(spark, ends), features, panel, none, "random_forest")
    failed = [r for r in made.collect() if r.fit_failed]
    assert failed and all(r.y_pred is None and "usable pairs (min 95)" in r.failure_reason for r in failed)
    assert any(not r.fit_failed for r in made.collect())
    # stored bytes that cannot be read fail the forecasts, not the fit
    broken = fits.withColumn("model", F.lit(b"x"))
    back = [r for r in learned.apply_fits(asked(spark, ends), features, broken, none).collect() if not r.fit_failed]
    assert back and all(r.forecast_failed and r.y_pred is None and r.failure_reason.startswith("forecast raised") for r in back)


def test_a_large_pool_is_thinned_by_hash(spark):
    ends = {f"s{i}": 120 for i in range(12)}
    features, panel = tables(spark, ends)
    rows = asked(spark, ends)
    whole = learned.pairs(rows, features, panel, ENGINE).groupBy(*learned.FIT).count().collect()
    some = learned.pairs(rows, features, panel, ENGINE.with_(fit_rows=200)).groupBy(*learned.FIT).count().collect()
    assert min(r["count"] for r in whole) > 400 and all(120 < r["count"] < 280 for r in some)


def test_blank_tail_follows_files_not_their_size(spark, tmp_path):
    def write(name, lines):
        (tmp_path / name).write_text("a,b\n" + "\n".join(lines) + "\n")

    write("part-0.csv", ["1,2"] * 3)
    write("part-1.csv", ["1,2"] * 2000)
    write("part-2.csv", ["3,4", ","])
    tail = raw_text.blank_tail(raw_text.read_raw(spark, str(tmp_path), ["a", "b"])).first()
    assert (tail["n_rows"], tail["n_blank"], tail["blank_tail_contiguous"]) == (2005, 1, True)
    write("part-0.csv", ["1,2", ",", "1,2"])
    tail = raw_text.blank_tail(raw_text.read_raw(spark, str(tmp_path), ["a", "b"])).first()
    assert tail["blank_tail_contiguous"] is False
