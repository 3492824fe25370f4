"""The hourly measures cover every model that the hourly predictions hold."""

from __future__ import annotations

import duckdb

from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_hourly_measures_hold_the_rows_of_their_sql(spark):
    duck = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = duck.execute(catalog.QUERIES["metrics_hourly"].check)
    at = [[d[0] for d in cursor.description].index(c) for c in ("series_id", "metric", "model", "window_rule", "horizon")]
    want = {tuple(r[i] for i in at) for r in cursor.fetchall()}
    made = catalog.run("metrics_hourly", spark, FOLDER)
    got = {(r.series_id, r.metric, r.model, r.window_rule, r.horizon) for r in made.collect()}
    assert got == want and {g[2] for g in got} == set(catalog.CHECKED_MODELS)
