"""From aligned observations to the master series and the long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.operators.calendar import align, by_series, keep_reporting_slots


def with_known(rows: DataFrame, measures: tuple) -> DataFrame:
    """Per measure and slot: the last present ``(pos, value)`` up to it and the next after it.

    Both are running look-ups of one ordering; a frame that reaches to the end of
    the partition would be evaluated anew for every row.
    """
    so_far = by_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.select(
        "*",
        *[
            F.when(F.col(m).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(m).alias("v"))).alias(f"_{m}")
            for m in measures
        ],
    )
    return marked.select(
        "*",
        *[F.last(f"_{m}", ignorenulls=True).over(so_far).alias(f"_{m}_before") for m in measures],
        *[
            F.expr(f"lead(_{m}) IGNORE NULLS OVER (PARTITION BY series_id ORDER BY pos)").alias(f"_{m}_after")
            for m in measures
        ],
    )


def interpolated(m: str) -> Column:
    """Linear fill by position, rounded half to even, over :func:`with_known` rows.

    A leading gap stays NULL and a trailing gap carries the last value.
    """
    a, b = F.col(f"_{m}_before"), F.col(f"_{m}_after")
    slope = F.try_divide(b["v"] - a["v"], (b["p"] - a["p"]).cast("double"))
    line = F.bround(slope * (F.col("pos") - a["p"]) + a["v"]).cast("bigint")
    return F.coalesce(F.col(m), F.when(b.isNull(), a["v"]).otherwise(line))


def master_series(obs: DataFrame, engine: Engine) -> DataFrame:
    """Aligned, flagged and filled: stocks are interpolated, flows are not touched.

    One row per series and slot:
    ``series_id, ds, pos, is_imputed, <measures>, is_imputed_<stock>``.
    """
    aligned = align(keep_reporting_slots(obs, engine), engine)
    return fill_stocks(aligned, engine)


def fill_stocks(aligned: DataFrame, engine: Engine) -> DataFrame:
    stocks = engine.stocks
    return with_known(aligned, stocks).select(
        "series_id",
        "ds",
        "pos",
        "is_imputed",
        *[
            interpolated(m).alias(m) if m in stocks else F.col(m)
            for m in engine.measure_names
        ],
        *[F.col(m).isNull().alias(f"is_imputed_{m}") for m in engine.stocks],
    )


def long_panel(master: DataFrame, engine: Engine, metrics: tuple | None = None) -> DataFrame:
    """``series_id, metric, kind, ds, pos, value, is_imputed``, one row per measure.

    A stock is imputed where it was filled, on missing slots and on reported ones without a value; a
    flow where the slot is missing.
    """
    kinds = {m.name: m.kind for m in engine.measures}
    names = metrics or engine.measure_names
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.lit(kinds[m]).alias("kind"),
                F.col(m).cast("double").alias("value"),
                F.col(f"is_imputed_{m}" if kinds[m] == "stock" else "is_imputed").alias("is_imputed"),
            )
            for m in names
        ]
    )
    return master.select("series_id", "ds", "pos", F.inline(cells)).select(
        "series_id", "metric", "kind", "ds", "pos", "value", "is_imputed"
    )


def by_metric() -> Window:
    return Window.partitionBy("series_id", "metric").orderBy("pos")


__all__ = ["by_metric", "by_series", "fill_stocks", "interpolated", "long_panel", "master_series"]
