from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.holidays import holidays, year_range
from tidemark.operators import calendar, cleaning, explore, features, quality
from tidemark.sources import provenance, raw_text, tables
from tests.helpers import ENGINE, master, panel

OBS = "series_id string, ds date, intake bigint, release bigint, load bigint"


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def test_gap_slots_stock_filled_flow_missing(spark):
    # Sunday, (Monday missing), (Tuesday missing), Wednesday; Friday and Saturday never expected
    rows = [("s", date(2023, 1, 1), 1, 1, 10), ("s", date(2023, 1, 4), 2, 2, 13), ("s", date(2023, 1, 8), 3, 3, 20)]
    got = cleaning.master_series(obs(spark, rows), ENGINE).orderBy("pos").collect()
    assert [r.ds.day for r in got] == [1, 2, 3, 4, 5, 8]
    assert [r.load for r in got] == [10, 11, 12, 13, 16, 20]  # 16.5 rounds to the even 16
    assert [r.intake for r in got] == [1, None, None, 2, None, 3]
    assert [r.is_imputed for r in got] == [False, True, True, False, True, False]


def test_interpolation_edges_match_pandas(spark):
    values = [None, None, 4, None, None, 9, None, 30, None, None]
    rows = [("s", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, pos int, v bigint")
    got = [r.x for r in cleaning.with_known(df, ("v",)).select("pos", cleaning.interpolated("v").alias("x")).orderBy("pos").collect()]
    want = pd.Series(values, dtype=float).interpolate("linear").round()
    assert got == [None if np.isnan(x) else int(x) for x in want]


def test_gate_rejects_mutations(spark):
    good = master(spark, 20, gaps=[5]).withColumn("ds", F.date_add(F.lit("2023-01-01").cast("date"), F.col("pos")))
    engine = ENGINE.with_(reporting_weekdays=tuple(range(7)))
    quality.enforce(quality.gate(good, engine))
    filled = good.withColumn("intake", F.coalesce("intake", F.lit(0)))
    dropped = good.filter("pos <> 7")
    reversed_ = good.withColumn("ds", F.date_sub(F.lit("2024-01-01").cast("date"), F.col("pos")))
    negative = good.withColumn("load", -F.col("load"))
    for bad in (filled, dropped, reversed_, negative):
        with pytest.raises(ValueError, match="validation failed"):
            quality.enforce(quality.gate(bad, engine))
    sizes = spark.createDataFrame([("s", 21)], "series_id string, n_slots bigint")
    with pytest.raises(ValueError, match="expected_n_slots"):
        quality.enforce(quality.gate(good, engine, sizes))


def test_rolling_excludes_the_current_row(spark):
    values = np.random.default_rng(0).integers(0, 100, size=80)
    m = master(spark, 80, gaps=[30, 31], load=lambda i: int(values[i]), flow=lambda i: int(values[i]))
    got = features.lag_and_rolling(m, ENGINE).orderBy("pos").toPandas()
    assert got["rolling_7_mean_load"][60] == pytest.approx(values[53:60].mean())
    flow = pd.Series([None if i in (30, 31) else float(v) for i, v in enumerate(values)]).shift(1)
    for k in (7, 14):
        for name, want in (
            ("mean", flow.rolling(k, min_periods=1).mean()), ("var", flow.rolling(k, min_periods=2).var()),
            ("nobs", flow.rolling(k, min_periods=1).count()),
        ):
            have = got[f"rolling_{k}_{name}_intake"].astype(float)
            np.testing.assert_allclose(have[1:], want[1:], rtol=1e-9)
    assert got["rolling_7_nobs_intake"][0] == 0 and pd.isna(got["rolling_7_mean_intake"][0])
    assert got["lag_14_load"][20] == values[6]


def test_holiday_dates_and_proximity(spark):
    got = {(r.year, r.holiday): r.ds for r in holidays(year_range(spark, 2020, 2025)).collect()}
    assert got[2024, "Thanksgiving"] == date(2024, 11, 28) and got[2023, "Memorial Day"] == date(2023, 5, 29)
    assert got[2021, "Independence Day (observed)"] == date(2021, 7, 5)
    assert got[2022, "Christmas Day (observed)"] == date(2022, 12, 26)
    assert got[2023, "Martin Luther King Jr. Day"] == date(2023, 1, 16)
    assert (2020, "Juneteenth National Independence Day") not in got
    days = master(spark, 730).withColumn("ds", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos")))
    near = {r.ds: r.is_near_holiday for r in features.calendar_features(days, ENGINE).collect()}
    assert near[date(2024, 7, 4)] == near[date(2024, 7, 2)] == near[date(2024, 7, 6)] == 1
    assert near[date(2024, 7, 7)] == 0


def test_predictors_hold_no_same_slot_value(spark):
    names = features.feature_columns(features.feature_table(master(spark, 30), ENGINE))
    assert not set(names) & {"intake", "release", "load", "net_flow", "ds", "pos"}
    assert len(names) == 3 + 4 * 3 + 4 * 2 * 3


def test_training_pair_counts(spark):
    m = master(spark, 200, gaps=[])
    table = features.feature_table(m, ENGINE)
    hole = F.when(F.col("pos").between(10, 39), F.lit(None)).otherwise(F.col("lag_1_load"))
    table = table.withColumn("lag_1_load", hole)
    windows = spark.createDataFrame([("s", "load", 20, 199, h) for h in (1, 7, 14)], "series_id string, metric string, train_start_pos int, train_cutoff_pos int, lead int")
    p = panel(spark, range(200))
    whole = {r.lead: r for r in features.training_pairs(table, p, windows, "lead", False).collect()}
    assert [whole[h].n_pairs for h in (1, 7, 14)] == [179, 173, 166]
    strict = {r.lead: r for r in features.training_pairs(table, p, windows, "lead", True).collect()}
    assert strict[1].n_pairs == 179 - 20 and strict[1].n_dropped == 20


def test_forward_calendar_skips_the_weekend(spark):
    m = master(spark, 5)
    got = calendar.forward_calendar(m, ENGINE).orderBy("pos").collect()
    assert [r.steps_ahead for r in got] == list(range(1, 15)) and got[0].pos == 5
    assert all(r.ds.weekday() not in (4, 5) and r.ds > date(2023, 1, 5) for r in got)


def test_raw_text_round_trip(spark, tmp_path):
    rows = [("s", date(2023, 1, 1) + timedelta(days=i), i, 2 * i, 1000 * i) for i in range(30)]
    path = str(tmp_path / "raw")
    raw_text.write_raw(obs(spark, rows), path, ENGINE, blank_rows=7)
    names = {"series_id": "series_id", "ds": "Date", **{m: m for m in ENGINE.measure_names}}
    raw = raw_text.read_raw(spark, path, list(names.values()), expected_rows=37)
    assert sorted(map(tuple, raw_text.observations(raw, ENGINE, names).collect())) == rows
    tail = raw_text.blank_tail(raw).first()
    assert (tail.n_blank, tail.blank_tail_contiguous) == (7, True)
    assert raw_text.parse_failures(raw, ENGINE, names).first().separated_load == 29
    with pytest.raises(ValueError, match="lacks column"):
        raw_text.read_raw(spark, path, ["Nope"])
    with pytest.raises(ValueError, match="expected 3 raw rows"):
        raw_text.read_raw(spark, path, ["Date"], expected_rows=3)


def test_missing_artifact_names_its_producer(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the backtest"):
        tables.read_artifact(spark, str(tmp_path / "none"), master(spark, 1).schema, "run the backtest")


def test_digest_changes_with_one_value(spark):
    a, b = master(spark, 20), master(spark, 20, load=lambda i: i + (i == 7))
    one = provenance.series_digests(a).first().series_sha256
    assert one == provenance.series_digests(a.orderBy(F.rand())).first().series_sha256
    assert one != provenance.series_digests(b).first().series_sha256
    differing = provenance.compare_provenance(provenance.provenance(a), provenance.provenance(b)).filter("NOT matches")
    assert [r.field for r in differing.collect()] == ["series_sha256"]


def test_chi_square_tail(spark):
    # textbook points
    rows = [(1, 3.841459, 0.05), (2, 5.991465, 0.05), (4, 9.487729, 0.05), (5, 11.070498, 0.05), (6, 12.591587, 0.05), (7, 24.321886, 0.001), (3, 0.0, 1.0), (9, 3000.0, 0.0), (6, 3000.0, 0.0)]
    df = spark.createDataFrame(rows, "df int, x double, want double")
    for r in df.select("want", explore.chi_square_tail(F.col("x"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-6)
    none = spark.createDataFrame([(None, 3), (1.0, None)], "x double, df int")
    assert {r[0] for r in none.select(explore.chi_square_tail(F.col("x"), F.col("df"))).collect()} == {None}


def test_partial_autocorrelation_of_an_ar1(spark):
    acf = 0.6 ** np.arange(6)
    pacf = explore.durbin_levinson(acf)
    np.testing.assert_allclose(pacf, [1, 0.6, 0, 0, 0, 0], atol=1e-12)


def test_adf_separates_noise_from_a_walk():
    noise = np.random.default_rng(0).normal(size=500)
    assert explore.adf_statistic(noise, 3) < explore.ADF_5PCT < explore.adf_statistic(np.cumsum(noise), 3)
