"""Statistical forecasts are taken from stored ones where those hold the window asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import harness
from tidemark.plans.workspace import CHECKED, open_workspace

FOLDER = "/root/testdata/sf0.001"


def test_only_windows_without_a_stored_forecast_are_fitted(spark, monkeypatch):
    space = open_workspace(spark, FOLDER, CHECKED, fresh=True)
    stored = space.statistical["exponential_smoothing"].localCheckpoint()
    wanted = space.requests.filter(F.col("metric").isin(*CHECKED.targets))
    part = stored.filter(F.pmod(F.hash("train_cutoff_pos"), F.lit(3)) > 0)
    asked = []
    fit = harness.smoothing_forecasts
    monkeypatch.setattr(harness, "smoothing_forecasts", lambda panel, rows, *more: asked.append(rows) or fit(panel, rows, *more))
    made = harness.statistical_fits(wanted, space.panel, CHECKED, "exponential_smoothing", part)
    key = lambda r: tuple(r[k] for k in harness.FITTED_BY)
    assert {key(r): r for r in made.select(*stored.columns).collect()} == {key(r): r for r in stored.collect()}
    missing = {key(r) for r in stored.collect()} - {key(r) for r in part.collect()}
    assert {key(r) for r in asked[0].collect()} == missing and missing
