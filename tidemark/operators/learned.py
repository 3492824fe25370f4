"""Tree ensembles over the pooled panel: fitted by a shared refit calendar, kept as a table, applied to any request.

A fit is a (metric, window rule, refit date, lead).  Refit dates are the first origin dates of every ``refit_days`` days, shared by all
series, and a fold is forecast by the newest fit not later than its origin.  A fit pools all series: each gives the pairs
(predictors at t, value at t + lead) inside the training window of its newest fold up to the refit date, so no label is later than
the date a forecast is made from.  The number of fits follows the calendar and not the number of series.  A fit takes every pair of
its pool, so its group holds a row for each series and slot at most, however many orders there are.

Spark groups the pairs by fit and every group grows its trees in one task; fits and forecasts are two steps, and the
table between them holds the trees themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.config import LEARNED, Engine
from tidemark.functions.trees import Trees, gradient_boosting, random_forest
from tidemark.operators.features import feature_columns
from tidemark.session import stage

FIT = ["metric", "window_rule", "refit_date", "lead"]
EPOCH = "1970-01-05"
SPREAD = 1 << 30
# requests of one fit are forecast by several tasks where they are many
ROWS_PER_SALT = 100_000
# partitions for every fit, so that hashing seldom puts several into one
PLACES_PER_FIT = 4
FITS = (
    "metric string, window_rule string, refit_date date, lead int, family string, n_pairs bigint, n_dropped bigint, fit_failed boolean, "
    "failure_reason string, importances array<struct<feature:string,importance:double>>, model binary"
)


def asked_fits(rows: DataFrame, engine: Engine) -> DataFrame:
    """Requests of the targets with the fit that forecasts them."""
    rows = rows.filter(F.col("metric").isin(*engine.targets))
    period = F.floor(F.datediff("origin_date", F.lit(EPOCH).cast("date")) / engine.refit_days)
    placed = rows.withColumn("_period", period)
    firsts = placed.groupBy("_period").agg(F.min(F.col("origin_date").cast("date")).alias("refit_date"))
    return placed.join(firsts, "_period").drop("_period").withColumn("lead", F.col("effective_lead").cast("int"))


def pool_windows(asked: DataFrame) -> DataFrame:
    """series_id, fit, first and last predictor position of every series' part in every fit."""
    by = Window.partitionBy("series_id", "metric", "window_rule").orderBy("origin_date")
    folds = asked.select(
        "series_id", "metric", "window_rule", F.col("origin_date").cast("date").alias("origin_date"), "train_start_pos", "train_cutoff_pos"
    ).distinct().withColumn("_next", F.lead("origin_date").over(by))
    dates = asked.select("refit_date").distinct().agg(F.array_sort(F.collect_set("refit_date"))).scalar()
    newest = (F.col("_date") >= F.col("origin_date")) & (F.col("_next").isNull() | (F.col("_date") < F.col("_next")))
    held = folds.withColumn("_dates", dates).withColumn("_date", F.explode("_dates")).filter(newest)
    leads = asked.select(*FIT).distinct()
    return held.select(
        "series_id", "metric", "window_rule", F.col("_date").alias("refit_date"), "train_start_pos", "train_cutoff_pos"
    ).join(leads, FIT[:3]).withColumn("last_pos", F.col("train_cutoff_pos") - F.col("lead")).filter(
        F.col("last_pos") >= F.col("train_start_pos")
    )


def shared_fits(windows: DataFrame) -> DataFrame:
    """Every fit with ``fit_rule``, the rule whose fit serves it.

    Where all rules of a metric, refit date and lead have the same window of every series, they have the same pairs and so the
    same trees: the first rule by name is fitted for all of them.
    """
    cell = ["metric", "refit_date", "lead"]
    by_series = windows.groupBy(*cell, "series_id").agg(
        F.count_distinct("window_rule").alias("_n"), F.size(F.collect_set(F.struct("train_start_pos", "last_pos"))).alias("_windows")
    )
    whole = by_series.groupBy(*cell).agg(F.min("_n").alias("_n"), F.max("_windows").alias("_windows"))
    rules = windows.groupBy(*cell).agg(F.array_sort(F.collect_set("window_rule")).alias("_rules"))
    same = (F.col("_windows") == 1) & (F.col("_n") == F.size("_rules"))
    return rules.join(whole, cell).select(*cell, F.explode("_rules").alias("window_rule"), "_rules", same.alias("_same")).select(
        *FIT, F.when(F.col("_same"), F.col("_rules")[0]).otherwise(F.col("window_rule")).alias("fit_rule")
    )


def pairs(rows: DataFrame, features: DataFrame, panel: DataFrame, engine: Engine) -> DataFrame:
    """Training pairs of every fit: series_id, fit, pos, label, predictors.

    A label lies inside the training window of its series; pairs without a label are left out.  Where ``fit_rows`` is set, about so many
    of each fit are drawn by hash, to look at a large pool; no fit is made from those.
    """
    windows = pool_windows(asked_fits(rows, engine))
    whole = window_pairs(windows, features, panel, engine)
    if engine.fit_rows is None:
        return whole
    sizes = windows.groupBy(*FIT).agg(F.sum(F.col("last_pos") - F.col("train_start_pos") + 1).alias("_pool"))
    share = F.least(F.lit(1.0), F.lit(float(engine.fit_rows)) / F.col("_pool"))
    return whole.join(sizes, FIT).filter(F.pmod(F.xxhash64("series_id", "pos"), F.lit(SPREAD)) < share * SPREAD).select(whole.columns)


def window_pairs(windows: DataFrame, features: DataFrame, panel: DataFrame, engine: Engine) -> DataFrame:
    """Every training pair inside given windows of series."""
    columns = feature_columns(features)
    leads = windows.select("metric", "lead").distinct()
    values = panel.filter(F.col("value").isNotNull()).select("series_id", "metric", F.col("pos").alias("label_pos"), F.col("value").alias("label"))
    labels = values.join(leads, "metric").select("series_id", "metric", "lead", (F.col("label_pos") - F.col("lead")).alias("pos"), "label")
    labelled = labels.join(features.select("series_id", "pos", *[F.col(c).cast("double").alias(c) for c in columns]), ["series_id", "pos"])
    inside = F.col("pos").between(F.col("train_start_pos"), F.col("last_pos"))
    return labelled.join(windows, ["series_id", "metric", "lead"]).filter(inside).select("series_id", *FIT, "pos", "label", *columns)


def _matrix(table: pa.Table, columns: list[str], order: np.ndarray | slice = slice(None)) -> np.ndarray:
    made = np.empty((table.num_rows, len(columns)))
    for j, c in enumerate(columns):
        made[:, j] = table.column(c).to_numpy()[order]
    return made


def fit_group(family: str, x: np.ndarray, y: np.ndarray, engine: Engine) -> tuple[Trees | None, np.ndarray, int, str]:
    """The trees of one fit, the predictors they know, the number of usable pairs, and why there are none.

    A forest trains on complete rows and fills gaps of a forecast's row with medians; boosting keeps gaps as gaps.  A predictor
    never seen is left out.
    """
    seen = ~np.isnan(x).all(axis=0) if len(x) else np.zeros(x.shape[1], bool)
    x = x[:, seen]
    if family == "random_forest":
        complete = ~np.isnan(x).any(axis=1)
        x, y = x[complete], y[complete]
    if len(y) < engine.min_pairs:
        return None, seen, len(y), f"only {len(y)} usable pairs (min {engine.min_pairs})"
    if family == "random_forest":
        made = random_forest(x, y, engine.trees, 8, 5, engine.seed)
    else:
        made = gradient_boosting(x, y, engine.boosting_rounds, 4, 5, 0.05, engine.seed)
    return made, seen, len(y), ""


def fit_table(rows: DataFrame, features: DataFrame, panel: DataFrame, engine: Engine, *families: str) -> DataFrame:
    """One row per fit and family: how many pairs it used and dropped, whether it failed and why, importances, and the trees.

    Fits without a single pair have no row.  A fit that raises is a failed row and does not end the others.  All families
    are fitted in one job, from pairs that are made once.
    """
    unknown = set(families) - set(LEARNED)
    if unknown or not families:
        raise ValueError(f"unknown family {sorted(unknown)}; expected some of {LEARNED}")
    columns = feature_columns(features)
    windows = stage(pool_windows(asked_fits(rows, engine)), "fit-windows")
    served = stage(shared_fits(windows), "shared-fits")
    fitted = served.filter(F.col("fit_rule") == F.col("window_rule")).select(*FIT)
    pairs = window_pairs(windows.join(fitted, FIT, "left_semi"), features, panel, engine)
    data = pairs.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    by = [*FIT, "family"]

    def fit(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("series_id", "ascending"), ("pos", "ascending")]).to_numpy()
        key = {k: table.column(k)[0].as_py() for k in by}
        x, y = _matrix(table, columns, order), table.column("label").to_numpy()[order].astype(float)
        del table
        try:
            made, seen, used, reason = fit_group(key["family"], x, y, engine)
        except (ValueError, FloatingPointError, np.linalg.LinAlgError, MemoryError) as problem:
            made, seen, used, reason = None, np.zeros(len(columns), bool), 0, f"fit raised {type(problem).__name__}: {problem}"
        known = [c for c, s in zip(columns, seen) if s]
        out = key | {
            "n_pairs": used, "n_dropped": len(y) - used, "fit_failed": made is None, "failure_reason": reason,
            "importances": [{"feature": c, "importance": float(v)} for c, v in zip(known, made.importance)] if made else [],
            "model": made.dump() if made else None,
        }
        return pa.Table.from_pylist([out], schema=_arrow_schema())

    # few tasks have several fits, so that the last tasks are not a queue of fits
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), PLACES_PER_FIT * len(families) * fitted.count())
    made = data.repartition(width, *by).groupBy(*by).applyInArrow(fit, FITS).withColumnRenamed("window_rule", "fit_rule")
    return made.join(served, ["metric", "refit_date", "lead", "fit_rule"]).select(*_arrow_schema().names)


def _arrow_schema() -> pa.Schema:
    importance = pa.list_(pa.struct([("feature", pa.string()), ("importance", pa.float64())]))
    kinds = {"string": pa.string(), "date": pa.date32(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds.get(k, importance)) for n, k in (f.split(" ", 1) for f in FITS.replace(", ", "|").split("|"))])


def apply_fits(rows: DataFrame, features: DataFrame, fits: DataFrame, engine: Engine) -> DataFrame:
    """``rows`` with y_pred from the stored trees, fit_failed, forecast_failed and failure_reason.

    A request takes the newest fit of its metric, rule and lead that is not later than its origin; its predictors are those at its
    training cutoff.  So stored fits answer later requests too, without being made again.  Requests without a window_rule take
    the deployed one.  A request whose fit is missing or failed, or whose forecast fails, has
    a null forecast and a reason; it ends no other.
    """
    columns = feature_columns(features)
    rule = F.col("window_rule") if "window_rule" in rows.columns else F.lit(engine.selection_rule)
    calendar = fits.groupBy("metric", F.col("window_rule").alias("_rule"), "lead").agg(F.collect_set("refit_date").alias("_dates"))
    asked = rows.filter(F.col("metric").isin(*engine.targets)).withColumn("lead", F.col("effective_lead").cast("int")).withColumn("_rule", rule)
    asked = asked.join(calendar, ["metric", "_rule", "lead"], "left")
    known = F.array_max(F.filter("_dates", lambda d: d <= F.col("origin_date").cast("date")))
    asked = asked.withColumn("refit_date", F.coalesce(known, F.lit(EPOCH).cast("date"))).drop("_dates")
    # a forecast depends on nothing else, so requests that agree in these are answered once
    keys = ["series_id", *FIT, "train_cutoff_pos"]
    places = [c if c != "window_rule" else "_rule" for c in keys]
    at = features.select("series_id", F.col("pos").alias("train_cutoff_pos"), *[F.col(c).cast("double").alias(c) for c in columns])
    distinct = asked.select(*[F.col(p).alias(k) for p, k in zip(places, keys)]).distinct()
    wanted = distinct.join(at, ["series_id", "train_cutoff_pos"], "left")
    sizes = distinct.groupBy(*FIT).agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("_salts"))
    wanted = wanted.join(sizes, FIT).withColumn("_salt", F.pmod(F.xxhash64("series_id", "train_cutoff_pos"), F.col("_salts")).cast("int")).drop("_salts")
    stored = fits.join(sizes, FIT).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    stored = stored.select(*[F.col(c).alias(f"fit_{c}") for c in (*FIT, "_salt")], "fit_failed", "failure_reason", "model", F.col("importances.feature").alias("known"))
    schema = ", ".join(f"{k} {dict(wanted.dtypes)[k]}" for k in keys) + ", y_pred double, fit_failed boolean, forecast_failed boolean, failure_reason string"

    def forecast(requests: pa.Table, stored: pa.Table) -> pa.Table:
        n = requests.num_rows
        y, failed, broken, reason = np.full(n, np.nan), np.ones(n, bool), np.zeros(n, bool), np.full(n, "no training pair", object)
        if stored.num_rows:
            failed[:] = stored.column("fit_failed")[0].as_py()
            reason[:] = stored.column("failure_reason")[0].as_py()
        if n and not failed.any():
            try:
                trees = Trees.load(stored.column("model")[0].as_py())
                y = trees.predict(_matrix(requests, stored.column("known")[0].as_py()))
                broken = ~np.isfinite(y)
                reason[broken] = "forecast is not finite"
            except (ValueError, KeyError, IndexError, OSError) as problem:
                broken[:], reason[:] = True, f"forecast raised {type(problem).__name__}: {problem}"
        made = [requests.column(k) for k in keys] + [
            pa.array(y, pa.float64(), mask=~np.isfinite(y)), pa.array(failed), pa.array(broken), pa.array(reason.tolist(), pa.string())
        ]
        return pa.table(made, names=[*keys, "y_pred", "fit_failed", "forecast_failed", "failure_reason"])

    by = [*FIT, "_salt"]
    made = wanted.groupBy(*by).cogroup(stored.groupBy(*[f"fit_{c}" for c in by])).applyInArrow(forecast, schema)
    back = asked.join(made.withColumnRenamed("window_rule", "_rule"), places).drop("refit_date", "lead", "_rule")
    return back.select("*", F.lit(None).cast("double").alias("y_pred_lo"), F.lit(None).cast("double").alias("y_pred_hi"))


def learned_forecasts(rows: DataFrame, features: DataFrame, panel: DataFrame, engine: Engine, family: str) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all requests of the targets, and the stored fits they come from."""
    fits = stage(fit_table(rows, features, panel, engine, family), f"fits-{family}")
    return apply_fits(rows, features, fits, engine).withColumn("model", F.lit(family)), fits


def importances(fits: DataFrame) -> DataFrame:
    """Importance per fit and predictor."""
    return fits.filter(~F.col("fit_failed")).select(
        "metric", "family", "window_rule", "refit_date", F.col("lead").alias("horizon"), F.explode("importances").alias("i"),
        F.col("n_pairs").alias("n_training_pairs"),
    ).select("metric", "family", "window_rule", "refit_date", "horizon", "i.feature", "i.importance", "n_training_pairs")


def top_features(table: DataFrame, n: int = 8) -> DataFrame:
    order = Window.partitionBy("metric", "family", "window_rule", "refit_date", "horizon").orderBy(
        F.col("importance").desc(), "feature"
    )
    return table.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def own_share(top: DataFrame) -> DataFrame:
    """Share of the top features' importance that sits on the target's own series."""
    own = F.when(F.contains(F.col("feature"), F.col("metric")), F.col("importance")).otherwise(0.0)
    return top.groupBy("metric", "family").agg(
        (F.try_divide(F.sum(own), F.sum("importance")) * 100).alias("own_share_pct")
    )
