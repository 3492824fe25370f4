"""A tree fit takes every pair of its pool, and grows from as many entries at a time as fit."""

import numpy as np
import pytest

from tidemark.config import Engine
from tidemark.functions import trees
from tidemark.operators import learned
from tests.test_learned import ENGINE, asked, tables


def test_no_fit_is_made_from_a_draw(spark):
    assert Engine().fit_rows is None
    ends = {f"s{i}": 120 for i in range(12)}
    features, panel = tables(spark, ends)
    rows = asked(spark, ends)
    windows = learned.pool_windows(learned.asked_fits(rows, ENGINE))
    held = {}
    for w in windows.collect():
        key = tuple(w[k] for k in learned.FIT)
        held[key] = held.get(key, 0) + w.last_pos - w.train_start_pos + 1
    assert min(held.values()) > 400
    few = ENGINE.with_(fit_rows=200)
    found = learned.window_pairs(windows, features, panel, few).groupBy(*learned.FIT).count().collect()
    assert {tuple(r[k] for k in learned.FIT): r["count"] for r in found} == held
    for family in ("random_forest", "gradient_boosting"):
        fits = learned.fit_table(rows, features, panel, few, family).collect()
        assert {tuple(r[k] for k in learned.FIT): r.n_pairs + r.n_dropped for r in fits} == held


@pytest.mark.parametrize("family", [trees.random_forest, trees.gradient_boosting])
def test_histograms_made_in_parts_are_those_made_at_once(family, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    y = np.rint(8 * x[:, 1]) + np.rint(3 * x[:, 4])
    small = (4, 3, 5, 1) if family is trees.random_forest else (4, 3, 5, 0.5, 1)
    whole = family(x, y, *small)
    monkeypatch.setattr(trees, "ENTRIES_AT_ONCE", 50)
    parts = family(x, y, *small)
    assert (parts.predictor == whole.predictor).all() and (parts.cut == whole.cut).all()
    assert parts.predict(x) == pytest.approx(whole.predict(x))
