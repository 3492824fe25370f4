"""All seven candidates from common support to the indicators, against the checking SQL over the staged predictions."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.config import LEARNED, STATISTICAL
from tidemark.plans import catalog, oracle_base as O
from tidemark.plans.workspace import ALL_MODELS, FULL, open_workspace

FOLDER = "/root/testdata/sf0.001"
# the engine as it stands, with few trees and with draws that SQL can repeat
ENGINE = FULL.with_(trees=4, boosting_rounds=4, refit_days=365, draws="portable")
TABLES = ("orders", "lineitem", "customer", "events")


@pytest.fixture(scope="module")
def whole(spark):
    return open_workspace(spark, FOLDER, ENGINE, models=ALL_MODELS, fresh=True)


@pytest.fixture(scope="module")
def duck(whole, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    whole.predictions.withColumn("series_id", F.col("series_id")).write.parquet(f"{folder}/pred")
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found.execute(f"CREATE VIEW pred AS SELECT {O.PRED_COLUMNS}, common_support FROM '{folder}/pred/*.parquet'")
    return found


def rows(duck, select):
    """Rows of ``select`` with the registered blocks, but the staged predictions and the true families in place of the checked ones."""
    kept = {k: O.BLOCKS[k] for k in ("pred", "first_winner", "second_winner")}
    try:
        del O.BLOCKS["pred"]
        O.BLOCKS["first_winner"] = O.winners(", ".join(f"'{m}'" for m in STATISTICAL), "first_model")
        O.BLOCKS["second_winner"] = O.winners(", ".join(f"'{m}'" for m in LEARNED), "second_model")
        cursor = duck.execute(O.sql(select))
    finally:
        O.BLOCKS.update(kept)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def same(duck, df, select):
    names, want = rows(duck, select)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in want), key=repr)
    assert len(got) == len(want) and len(got) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-6, abs=1e-6) if isinstance(y, float) else y), (a, b)


def test_every_candidate_forecasts_every_request(whole):
    counts = {(r.model, r.metric): r["count"] for r in whole.predictions.groupBy("model", "metric").count().collect()}
    for metric in ENGINE.targets:
        assert {counts[m, metric] for m in ALL_MODELS} == {counts["naive", metric]}
    failed = whole.predictions.filter(F.col("y_pred").isNull() & F.col("failure_reason").isin("") & ~F.col("model").isin("naive", "seasonal_naive", "moving_average"))
    assert failed.count() == 0


def test_failures_reach_the_reliability_tables(whole, duck):
    same(duck, catalog.scoring.fit_reliability(whole.predictions), re.sub(r"\s+", " ", f"""
        SELECT metric, model, count(*) AS fits_attempted, count(CASE WHEN fit_failed THEN 1 END) AS fits_failed,
            100 * (1 - count(CASE WHEN fit_failed THEN 1 END) / count(*)) AS success_rate_pct FROM {catalog.FITS.format(t="pred")} GROUP BY 1, 2"""))
    same(duck, catalog.scoring.failure_reasons(whole.predictions), f"SELECT model, failure_reason, count(*) AS folds FROM {catalog.FITS.format(t='pred')} WHERE fit_failed GROUP BY 1, 2")


def test_ensemble_is_the_best_statistical_with_the_best_learned(whole, duck):
    same(duck, whole.pairs, "SELECT * FROM pairs")
    pairs = whole.pairs.collect()
    assert all(p.first_model in STATISTICAL and p.second_model in LEARNED for p in pairs)
    keep = ["series_id", "metric", "window_rule", "fold_id", "horizon", "y_pred", "ensemble_components"]
    same(duck, whole.ensemble.select(*keep), f"SELECT {', '.join(keep)} FROM ens")


def test_selection_over_all_candidates(whole, duck):
    same(duck, whole.combined_metrics, "SELECT * FROM cmetrics")
    columns = [catalog.joined(c) if c in catalog.LISTS else c for c in catalog.CHAMPION]
    same(duck, whole.champions.select(*columns), f"SELECT {', '.join(catalog.CHAMPION)} FROM champions")


def test_forward_forecasts_of_every_model(whole):
    made = whole.forward.collect()
    cells = {(r.series_id, r.metric, r.horizon) for r in made}
    assert {r.model for r in made} == {*ALL_MODELS, "ensemble"}
    by_cell = {}
    for r in made:
        by_cell.setdefault((r.series_id, r.metric, r.horizon), {})[r.model] = r
    pairs = {(p.series_id, p.metric, p.horizon): p for p in whole.pairs.collect()}
    champions = {(c.series_id, c.metric, c.horizon): c.champion for c in whole.champions.collect()}
    assert len(champions) > 0
    for cell in cells:
        chosen = [r.model for r in by_cell[cell].values() if r.is_champion]
        assert chosen == ([champions[cell]] if champions.get(cell) else [])
        if cell not in pairs:
            continue
        one, two = (by_cell[cell][m].point_forecast for m in (pairs[cell].first_model, pairs[cell].second_model))
        got = by_cell[cell]["ensemble"].point_forecast
        assert got == (pytest.approx((one + two) / 2) if one is not None and two is not None else None)


def test_indicators_follow_the_champions(whole):
    kpis = {(r.series_id, r.metric): r for r in whole.kpis.collect()}
    champions = {(r.series_id, r.metric, r.horizon): r for r in whole.champions.collect()}
    smape = {
        (r.series_id, r.metric, r.horizon, r.model): r.sMAPE for r in whole.governing_cells.collect()
    }
    assert len(kpis) == len({k[:2] for k in champions})
    for (series, metric), r in kpis.items():
        model = champions[series, metric, 1].champion
        assert r.forecast_accuracy_pct == pytest.approx(100 - smape[series, metric, 1, model])
