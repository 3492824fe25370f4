"""Data-quality gates, profiles and audits of raw observations and master series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import Engine
from tidemark.operators.calendar import by_series, on_template, template_slots

# Short weekday names, Monday first.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def weekday_name(ds: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ds))


def checks(counts: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Unfold one row of violation counts into ``check, n_violations, passed`` rows."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_violations")) for n in names])
    return counts.select(*keys, F.inline(rows)).withColumn("passed", F.col("n_violations") == 0)


def gate(master: DataFrame, engine: Engine, expected: DataFrame | None = None) -> DataFrame:
    """Every invariant of a master series as one row per series and check.

    ``expected`` may fix ``n_slots, n_real, n_gaps, n_on_template`` per series.
    The order and uniqueness checks compare neighbouring slots only.
    """
    w = by_series()
    off = ~on_template(F.col("ds"), engine)
    gap = F.col("is_imputed")
    previous = F.lag("ds").over(w)
    violations: dict[str, Column] = {
        "chronological": F.coalesce(F.col("ds") < F.col("prev"), F.lit(False)),
        "unique_dates": F.coalesce(F.col("ds") == F.col("prev"), F.lit(False)),
        "dense_positions": F.col("pos") != F.col("place"),
        "off_template_is_real": off & gap,
        "gap_flag_present": gap.isNull(),
    }
    for m in engine.measures:
        if m.kind == "flow":
            violations[f"{m.name}_missing_iff_gap"] = F.col(m.name).isNull() != gap
        else:
            # a leading gap has nothing to be filled from and stays missing
            violations[f"{m.name}_missing_only_at_first"] = F.col(m.name).isNull() & (F.col(f"seen_{m.name}") > 0)
            violations[f"{m.name}_flag_present"] = F.col(f"is_imputed_{m.name}").isNull()
        violations[f"{m.name}_not_negative"] = F.coalesce(F.col(m.name) < 0, F.lit(False))
    marked = master.select(
        "*", previous.alias("prev"), (F.row_number().over(w) - 1).alias("place"),
        *[F.count(m).over(w).alias(f"seen_{m}") for m in engine.stocks],
    )
    counts = marked.groupBy("series_id").agg(
        *[F.count_if(bad).alias(name) for name, bad in violations.items()],
        F.count(F.lit(1)).alias("n_slots"),
        F.count_if(~gap).alias("n_real"),
        F.count_if(gap).alias("n_gaps"),
        F.count_if(~off).alias("n_on_template"),
    )
    names = list(violations)
    if expected is not None:
        sizes = [c for c in expected.columns if c != "series_id"]
        counts = counts.join(
            expected.select("series_id", *[F.col(c).alias(f"want_{c}") for c in sizes]), "series_id", "left"
        ).withColumns(
            {f"expected_{c}": (~F.col(c).eqNullSafe(F.col(f"want_{c}"))).cast("bigint") for c in sizes}
        )
        names += [f"expected_{c}" for c in sizes]
    return checks(counts, names, ["series_id"])


def enforce(report: DataFrame) -> None:
    """Raise on the first violated invariant; one row at most reaches the driver."""
    failed = report.filter("NOT passed").orderBy("series_id", "check").limit(1).collect()
    if failed:
        row = failed[0]
        raise ValueError(
            f"master-series validation failed: {row['check']} in {row['series_id']} "
            f"({row['n_violations']} violations)"
        )


def overall(report: DataFrame) -> DataFrame:
    """Verdict per series over any check table."""
    return report.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.bool_and("passed").alias("all_passed"),
    )


def schedule_gaps(obs: DataFrame, engine: Engine) -> DataFrame:
    """Expected but unreported slots, and reported but unexpected ones."""
    spine = template_slots(obs, engine)
    missing = spine.join(obs, ["series_id", "ds"], "left_anti").withColumn("finding", F.lit("gap"))
    extra = obs.join(spine, ["series_id", "ds"], "left_anti").select("series_id", "ds").withColumn(
        "finding", F.lit("off_schedule")
    )
    return missing.unionByName(extra)


def schedule_summary(obs: DataFrame, engine: Engine) -> DataFrame:
    table = schedule_gaps(obs, engine).groupBy("series_id").agg(
        F.count_if(F.col("finding") == "gap").alias("gap_count"),
        F.count_if(F.col("finding") == "off_schedule").alias("off_schedule_count"),
    )
    counts = obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_observed"))
    return counts.join(table, "series_id", "left").select(
        "series_id", "n_observed",
        F.coalesce("gap_count", F.lit(0).cast("bigint")).alias("gap_count"),
        F.coalesce("off_schedule_count", F.lit(0).cast("bigint")).alias("off_schedule_count"),
    )


def nulls_and_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per series: NULLs of every column, repeated keys and repeated whole rows.

    Repeats come from counting equal rows, so no group is ever collected.
    """
    columns = [c for c in rows.columns if c not in key]
    distinct_rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    per_key = distinct_rows.groupBy(*key).agg(
        F.sum("copies").alias("n_rows"),
        F.sum(F.col("copies") - 1).alias("extra_rows"),
        *[F.sum(F.when(F.col(c).isNull(), F.col("copies")).otherwise(0)).alias(c) for c in columns],
    )
    return per_key.groupBy("series_id").agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(c).alias(f"nulls_{c}") for c in columns],
        F.sum(F.col("n_rows") - 1).alias("duplicate_dates"),
        F.sum("extra_rows").alias("duplicate_rows"),
    )


def column_profile(panel: DataFrame) -> DataFrame:
    """Range, moments, zeros and negatives of the observed values of every measure."""
    v = F.when(~F.col("is_imputed"), F.col("value"))
    return panel.groupBy("series_id", "metric").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.try_divide(F.max(v), F.nullif(F.min(v), F.lit(0.0))).alias("range_ratio"),
        F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"),
    )


def data_dictionary(panel: DataFrame, engine: Engine) -> DataFrame:
    """Measures by kind; ``n_present`` counts interpolated slots, ``n_reported`` does not."""
    return panel.groupBy("metric", "kind").agg(
        F.count("value").alias("n_present"),
        F.count(F.when(~F.col("is_imputed"), F.col("value"))).alias("n_reported"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
    ).withColumn(
        "missing_handling",
        F.when(F.col("kind") == "stock", F.lit("interpolated_and_flagged")).otherwise(
            F.lit("left_missing")
        ),
    ).withColumn(
        "role",
        F.when(F.col("metric").isin(*engine.targets), F.lit("target")).otherwise(
            F.lit("component")
        ),
    )


def weekday_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        "series_id", F.weekday("ds").alias("weekday"), weekday_name(F.col("ds")).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


def sort_direction(rows: DataFrame, order: str) -> DataFrame:
    """Whether dates run ascending, descending, and without repeats along ``order``."""
    w = Window.partitionBy("series_id").orderBy(order)
    step = rows.select("series_id", "ds", F.lag("ds").over(w).alias("prev"))
    seen = F.col("prev").isNotNull()
    return step.groupBy("series_id").agg(
        F.coalesce(F.bool_and(F.when(seen, F.col("ds") >= F.col("prev"))), F.lit(True)).alias("ascending"),
        F.coalesce(F.bool_and(F.when(seen, F.col("ds") <= F.col("prev"))), F.lit(True)).alias("descending"),
        (F.count("ds") == F.count_distinct("ds")).alias("unique"),
    )


def flow_identity(obs: DataFrame, engine: Engine) -> DataFrame:
    """``stock[t] = stock[t-1] + inflow[t] - outflow[t]`` on consecutive raw observations."""
    w = Window.partitionBy("series_id").orderBy("ds")
    expected = F.lag(engine.level).over(w) + F.col(engine.inflow) - F.col(engine.outflow)
    table = obs.select("series_id", (F.col(engine.level) - expected).cast("double").alias("r"))
    return table.groupBy("series_id").agg(
        F.count("r").alias("n_checked"), F.count_if(F.col("r") == 0).alias("n_exact"),
        (F.avg((F.col("r") == 0).cast("double")) * 100).alias("pct_exact"),
        F.percentile("r", F.lit(0.5)).alias("median"), F.avg("r").alias("mean"), F.min("r").alias("min"),
        F.max("r").alias("max"), F.stddev_pop("r").alias("std"),
    )


def reconciliation(master: DataFrame, engine: Engine) -> DataFrame:
    """The same identity where this and the previous slot are really observed."""
    w = by_series()
    flag = F.col(f"is_imputed_{engine.level}")
    residual = F.col(engine.level) - (
        F.lag(engine.level).over(w) + F.col(engine.inflow) - F.col(engine.outflow)
    )
    usable = ~flag & ~F.coalesce(F.lag(flag).over(w), F.lit(True)) & residual.isNotNull()
    table = master.select("series_id", F.when(usable, residual.cast("double")).alias("r"))
    return table.groupBy("series_id").agg(
        F.count("r").alias("n_testable"), F.count_if(F.col("r") == 0).alias("n_exact"),
        (F.avg((F.col("r") == 0).cast("double")) * 100).alias("pct_exact"),
        F.percentile(F.abs("r"), F.lit(0.5)).alias("median_abs"), F.avg("r").alias("mean_signed"),
    )


def regime(panel: DataFrame) -> DataFrame:
    """Peak, trough, their ratio and dates (first on a tie), and the last value."""
    v = F.col("value")
    early = F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("pos")).alias("p")))
    late = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("pos").alias("p")))
    return panel.groupBy("series_id", "metric").agg(
        F.max(v).alias("max"), F.min(v).alias("min"),
        F.try_divide(F.max(v), F.nullif(F.min(v), F.lit(0.0))).alias("ratio"),
        F.max_by(v, F.when(v.isNotNull(), F.col("pos"))).alias("last"),
        F.max_by("ds", early).alias("peak_ds"), F.min_by("ds", late).alias("trough_ds"),
    )


def raw_to_clean(obs: DataFrame, master: DataFrame, engine: Engine) -> DataFrame:
    """Every raw date survives and every published value is unchanged."""
    clean = master.select(
        "series_id", "ds", F.lit(True).alias("kept"),
        *[F.col(m).alias(f"clean_{m}") for m in engine.measure_names],
    )
    joined = obs.join(clean, ["series_id", "ds"], "left")
    return joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col("kept").isNull()).alias("n_lost_dates"),
        *[
            F.count_if(F.col("kept") & F.col(m).isNotNull() & ~F.col(m).eqNullSafe(F.col(f"clean_{m}"))).alias(f"n_changed_{m}")
            for m in engine.measure_names
        ],
    )


def zero_listing(panel: DataFrame, engine: Engine) -> DataFrame:
    """Observed zeros of every flow with weekday and month; a flow without any keeps one row."""
    flows = panel.filter(F.col("kind") == "flow")
    zero = ~F.col("is_imputed") & (F.col("value") == 0)
    found = flows.filter(zero).select(
        "series_id", "metric", "ds", F.date_format("ds", "EEEE").alias("weekday"),
        F.date_format("ds", "MMMM").alias("month"),
    )
    counts = flows.groupBy("series_id", "metric").agg(F.count_if(zero).alias("n_zero"))
    return counts.join(found, ["series_id", "metric"], "left")
