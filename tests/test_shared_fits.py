"""Fits and forecasts that agree are made once, and are those that would be made apart."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from tidemark.config import LEARNED
from tidemark.functions.trees import Trees
from tidemark.operators import learned
from tidemark.plans.workspace import ALL_MODELS, FULL, open_workspace
from tidemark.session import ship_package, side_by_side

FOLDER = "/root/testdata/sf0.001"
ENGINE = FULL.with_(trees=3, boosting_rounds=2, refit_days=730)


@pytest.fixture(scope="module")
def space(spark):
    ship_package(spark)
    return open_workspace(spark, FOLDER, ENGINE, fresh=True)


def test_rules_with_the_same_windows_share_one_fit(space):
    windows = learned.pool_windows(learned.asked_fits(space.requests, ENGINE))
    served = learned.shared_fits(windows)
    held = {}
    for w in windows.collect():
        held.setdefault((w.metric, w.refit_date, w.lead), {}).setdefault(w.window_rule, set()).add((w.series_id, w.train_start_pos, w.last_pos))
    got = {(r.metric, r.refit_date, r.lead, r.window_rule): r.fit_rule for r in served.collect()}
    want = {}
    for cell, rules in held.items():
        same = len({frozenset(v) for v in rules.values()}) == 1
        want |= {(*cell, rule): min(rules) if same else rule for rule in rules}
    assert got == want
    assert {a[3] == b for a, b in got.items()} == {True, False}


def test_shared_trees_are_those_of_each_rule(space):
    family = "random_forest"
    stored = {tuple(r[k] for k in learned.FIT): r for r in space.learned_fits(family).collect()}
    columns = learned.feature_columns(space.features)
    pairs = learned.pairs(space.requests, space.features, space.targets, ENGINE).toPandas()
    groups = {k: g.sort_values(["series_id", "pos"]) for k, g in pairs.groupby(learned.FIT)}
    assert set(groups) == set(stored)
    for key, group in groups.items():
        made, _, used, reason = learned.fit_group(family, group[columns].to_numpy(float), group["label"].to_numpy(float), ENGINE)
        assert (stored[key].n_pairs, stored[key].failure_reason) == (used, reason)
        if made:
            held = Trees.load(stored[key].model)
            for name in ("predictor", "cut", "value", "importance", "medians"):
                assert np.array_equal(getattr(held, name), getattr(made, name))


def test_both_families_are_fitted_from_pairs_made_once(spark, monkeypatch):
    few = ENGINE.with_(refit_days=3650)
    space = open_workspace(spark, FOLDER, few, models=ALL_MODELS, fresh=True)
    calls, pairs = [], learned.window_pairs
    monkeypatch.setattr(learned, "window_pairs", lambda *given: calls.append(given) or pairs(*given))
    together = {f: {tuple(r[k] for k in learned.FIT): r for r in space.learned_fits(f).collect()} for f in LEARNED}
    assert len(calls) == 1
    for family in LEARNED:
        apart = {tuple(r[k] for k in learned.FIT): r for r in learned.fit_table(space.requests, space.features, space.targets, few, family).collect()}
        assert together[family].keys() == apart.keys() and len(apart) > 0
        for key, row in apart.items():
            assert together[family][key].asDict() == row.asDict()


def test_independent_steps_run_at_the_same_time(spark):
    meeting = threading.Barrier(2, timeout=60)

    def step(n):
        meeting.wait()
        return spark.range(n).count()

    assert side_by_side(spark, lambda: step(3), lambda: step(5)) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda: 1, lambda: 1 / 0)
