"""Every registered query: a Spark plan over a workspace and, where SQL can state
the same thing, the checking statement."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.config import BASELINES, Engine
from tidemark.functions import scores as S
from tidemark.functions.holidays import holidays
from tidemark.operators import (
    calendar, cleaning, explore, features, folds, harness, imbalance, intervals, kpi, learned, quality, smoothing,
    scoring, selection, warning,
)
from tidemark.plans import oracle_base as O
from tidemark.plans.oracle_base import sql
from tidemark.plans.workspace import ALL_MODELS, CHECKED, CHECKED_MODELS, FIVE_DAY, FULL, HOURLY, Workspace, open_workspace
from tidemark.session import shared_folder
from tidemark.sources import provenance, raw_text, tables


@dataclass(frozen=True)
class Query:
    plan: Callable[[Workspace], DataFrame]
    check: str | None
    key: str
    engine: Engine
    models: tuple


QUERIES: dict[str, Query] = {}


def add(
    name: str, plan: Callable[[Workspace], DataFrame], select: str | None = None, rounded: str = "",
    key: str = "priority", engine: Engine = CHECKED, models: tuple = CHECKED_MODELS,
) -> None:
    QUERIES[name] = Query(plan, sql(select, rounded) if select else None, key, engine, models)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (and no negative zero), so results compare across engines.

    The nudge keeps exact ties from falling differently after summation noise.
    """
    return df.select(*[
        (F.round(F.col(f.name) + F.lit(1e-9), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def run(name: str, spark: SparkSession, folder: str, fresh: bool = False) -> DataFrame:
    q = QUERIES[name]
    return rounded(q.plan(open_workspace(spark, folder, q.engine, q.key, q.models, fresh)))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def joined(names: str) -> Column:
    return F.array_join(F.col(names), ",").alias(names)


E_ = CHECKED
RAW_NAMES = {"series_id": "series_id", "ds": "Date", **{m: m for m in E_.measure_names}}
RAW_COLUMNS = ["series_id", "Date", *E_.measure_names]
BLANKS = 450


# ================================================================= sources, sinks
def _raw_file(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "raw-text")
    raw_text.write_raw(w.raw, path, w.engine, BLANKS)
    return raw_text.read_raw(w.spark, path, RAW_COLUMNS)


add("raw_text_round_trip", lambda w: raw_text.observations(_raw_file(w), w.engine, RAW_NAMES),
    "SELECT series_id, ds, intake, release, load FROM daily")
add("raw_text_blank_tail",
    lambda w: raw_text.blank_tail(_raw_file(w)).select("n_rows", "n_blank", "blank_tail_contiguous"),
    f"SELECT count(*) + {BLANKS} AS n_rows, CAST({BLANKS} AS BIGINT) AS n_blank, true AS blank_tail_contiguous FROM daily")
add("raw_text_parse_failures", lambda w: raw_text.parse_failures(_raw_file(w), w.engine, RAW_NAMES),
    """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS failed_ds, CAST(0 AS BIGINT) AS failed_intake,
        CAST(0 AS BIGINT) AS failed_release, CAST(0 AS BIGINT) AS failed_load,
        count(CASE WHEN intake >= 1000 THEN 1 END) AS separated_intake,
        count(CASE WHEN release >= 1000 THEN 1 END) AS separated_release,
        count(CASE WHEN load >= 1000 THEN 1 END) AS separated_load FROM daily""")


def _table_round_trip(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "panel")
    tables.write_table(w.panel, path, ("metric",))
    return tables.read_table(w.spark, path, w.panel.schema).select(*w.panel.columns)


def _artifact_round_trip(w: Workspace) -> DataFrame:
    manifest = folds.fold_manifest(w.folds, w.engine)
    path = scratch(w.spark, "manifest")
    tables.write_artifact(manifest, path)
    return tables.read_artifact(w.spark, path, manifest.schema, "folds.fold_manifest")


MANIFEST = """
    SELECT series_id, fold_id, origin_pos, origin_date, train_cutoff_pos,
        max(CASE WHEN horizon = 1 THEN test_pos END) AS test_pos_h1, max(CASE WHEN horizon = 7 THEN test_pos END) AS test_pos_h7,
        max(CASE WHEN horizon = 14 THEN test_pos END) AS test_pos_h14,
        max(CASE WHEN horizon = 1 THEN effective_lead END) AS effective_lead_h1, max(CASE WHEN horizon = 7 THEN effective_lead END) AS effective_lead_h7,
        max(CASE WHEN horizon = 14 THEN effective_lead END) AS effective_lead_h14, origin_is_imputed, origin_adjacent_to_gap,
        bool_or(CASE WHEN horizon = 1 THEN test_is_imputed END) AS test_is_imputed_h1, bool_or(CASE WHEN horizon = 7 THEN test_is_imputed END) AS test_is_imputed_h7,
        bool_or(CASE WHEN horizon = 14 THEN test_is_imputed END) AS test_is_imputed_h14, gap_contaminated
    FROM {t} GROUP BY series_id, fold_id, origin_pos, origin_date, train_cutoff_pos, origin_is_imputed, origin_adjacent_to_gap, gap_contaminated"""

add("panel_table_round_trip", _table_round_trip, "SELECT * FROM panel", "value")
add("artifact_csv_round_trip", _artifact_round_trip, MANIFEST.format(t="folds"))


def _registry(w: Workspace) -> DataFrame:
    return tables.registry_entries(selection.two_scope_selection(w.combined, w.engine), w.evidence)


def _registry_round_trip(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "registry")
    tables.write_json(_registry(w), path)
    back = tables.read_json(w.spark, path, tables.ENTRY)
    return back.select(
        "series_id", "metric", "horizon", "champion", "champion_mae", "reason", "champion_full_dev",
        "rankings_agree", "n_scored", joined("gate_cleared_by"), joined("tied_with_best"), joined("bias_screened_out"),
        F.size("full_dev_ranking").alias("n_ranked"), F.size("bias_diagnostics").alias("n_bias"),
        F.size("stability_diagnostics").alias("n_stability"), F.size("bootstrap_evidence").alias("n_bootstrap"),
        F.try_element_at("bias_diagnostics", "champion")["bias_ratio"].alias("champion_bias_ratio"),
        F.try_element_at("stability_diagnostics", "champion")["tail_ratio"].alias("champion_tail_ratio"),
    )


add("registry_json_round_trip", _registry_round_trip, """
    SELECT f.series_id, f.metric, f.horizon, g.champion, g.champion_mae, coalesce(g.reason, 'no_finite_error') AS reason, f.champion AS champion_full_dev,
        f.champion IS NOT DISTINCT FROM g.champion AS rankings_agree, coalesce(g.n_scored, 0) AS n_scored, g.gate_cleared_by, g.tied_with_best, g.bias_screened_out,
        CAST(n.n_ranked AS INTEGER) AS n_ranked, CAST(e.n_judged AS INTEGER) AS n_bias, CAST(e.n_judged AS INTEGER) AS n_stability,
        CAST(e.n_bootstrap AS INTEGER) AS n_bootstrap, t.bias_ratio AS champion_bias_ratio, t.tail_ratio AS champion_tail_ratio
    FROM f_champions f
    LEFT JOIN champions g ON f.series_id = g.series_id AND f.metric = g.metric AND f.horizon = g.horizon
    JOIN (SELECT series_id, metric, horizon, count(*) AS n_ranked FROM f_maes GROUP BY 1, 2, 3) n
        ON n.series_id = f.series_id AND n.metric = f.metric AND n.horizon = f.horizon
    LEFT JOIN (SELECT series_id, metric, horizon, count(CASE WHEN tied OR NOT any_passed THEN 1 END) AS n_judged,
              count(CASE WHEN any_passed AND viable AND model <> leader_model THEN 1 END) AS n_bootstrap FROM tied GROUP BY 1, 2, 3) e
        ON e.series_id = g.series_id AND e.metric = g.metric AND e.horizon = g.horizon
    LEFT JOIN tied t ON t.series_id = g.series_id AND t.metric = g.metric AND t.horizon = g.horizon AND t.model = g.champion""",
    "champion_mae champion_bias_ratio champion_tail_ratio")
add("registry_document", lambda w: tables.registry_document(
    _registry(w),
    {"gate": "must beat both references on MAE, strictly", "ranking_scope": w.engine.selection_scope,
     "window_rule": w.engine.selection_rule, "tie_break": "prefer unbiased, then the simpler model"},
    provenance.provenance(w.master)))
add("file_digests", lambda w: provenance.file_digests(
    w.spark, [f"{w.folder}/{t}.parquet" for t in ("orders", "lineitem", "customer", "events")]))

ROW_TEXT = """concat_ws('|', CAST(ds AS VARCHAR), CAST(pos AS VARCHAR), CAST(is_imputed AS VARCHAR), coalesce(CAST(intake AS VARCHAR), ''),
    coalesce(CAST(release AS VARCHAR), ''), coalesce(CAST(load AS VARCHAR), ''), CAST(is_imputed_load AS VARCHAR))"""
add("row_digests", lambda w: provenance.row_digests(w.master),
    f"SELECT series_id, pos, sha256({ROW_TEXT}) AS row_sha256 FROM master")
DIGESTS = f"SELECT series_id, sha256(string_agg(h, chr(10) ORDER BY pos)) AS series_sha256 FROM (SELECT series_id, pos, sha256({ROW_TEXT}) AS h FROM master) GROUP BY 1"
add("series_digests", lambda w: provenance.series_digests(w.master), DIGESTS)
add("table_digest", lambda w: provenance.table_digest(w.master), f"""
    SELECT count(*) AS n_rows, {" || ".join(f"printf('%08x', CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT))" for k in range(4))} AS digest
    FROM (SELECT sha256(series_id || '|' || {ROW_TEXT}) AS h FROM master)""")
PROVENANCE = f"""
    SELECT m.*, d.series_sha256 FROM (SELECT series_id, count(*) AS n_period_positions, count(CASE WHEN NOT is_imputed THEN 1 END) AS n_real_observations,
        count(CASE WHEN is_imputed THEN 1 END) AS n_gap_slots, max(ds) AS data_as_of, min(ds) AS series_starts FROM master GROUP BY 1) m
    JOIN ({DIGESTS}) d ON d.series_id = m.series_id"""
add("provenance_record", lambda w: provenance.provenance(w.master), PROVENANCE)


def _provenance_match(w: Workspace) -> DataFrame:
    # the second record comes from the same rows after a text round trip, minus the last day
    last = F.max("ds").over(Window.partitionBy("series_id"))
    shorter = w.raw.withColumn("last", last).filter(F.col("ds") < F.col("last")).drop("last")
    return provenance.compare_provenance(
        provenance.provenance(w.master), provenance.provenance(cleaning.master_series(shorter, w.engine))
    ).select("series_id", "field", "left_value", "matches")


PROVENANCE_FIELDS = ("n_period_positions", "n_real_observations", "n_gap_slots", "data_as_of", "series_starts", "series_sha256")
add("provenance_match", _provenance_match, f"""
    WITH one AS ({PROVENANCE}), two AS ({re.sub("FROM master", "FROM less_master", PROVENANCE)})
    SELECT coalesce(one.series_id, two.series_id) AS series_id, f.field, f.a AS left_value, f.a IS NOT DISTINCT FROM f.b AS matches
    FROM one FULL JOIN two ON two.series_id = one.series_id, LATERAL (SELECT unnest([{", ".join(
        f"{{'field': '{c}', 'a': CAST(one.{c} AS VARCHAR), 'b': CAST(two.{c} AS VARCHAR)}}" for c in PROVENANCE_FIELDS)}], recursive := true)) f""")

# ================================================================= calendar, cleaning, quality
add("calendar_spine", lambda w: calendar.reporting_spine(w.obs, w.engine), "SELECT series_id, ds FROM spine")
add("aligned_slots", lambda w: calendar.align(w.obs, w.engine), "SELECT * FROM aligned")
add("date_labels", lambda w: w.master.select("series_id", "pos", calendar.slot_label(F.col("ds")).alias("label")),
    "SELECT series_id, pos, strftime(ds, '%B %d, %Y') AS label FROM master")
add("master_series", lambda w: w.master, "SELECT * FROM master")
add("master_series_by_nation", lambda w: w.master, "SELECT * FROM n_master", key="nation")
add("master_series_hourly", lambda w: w.master, "SELECT * FROM e_master", key="events", engine=HOURLY)
add("long_panel", lambda w: w.panel, "SELECT * FROM panel", "value")


def _gate_sql(count_rows: str) -> str:
    bad = {
        "chronological": "ds < prev", "unique_dates": "ds = prev", "dense_positions": "pos <> place",
        "off_template_is_real": "isodow(ds) - 1 NOT IN (0, 1, 2, 3, 4, 5, 6) AND is_imputed", "gap_flag_present": "is_imputed IS NULL",
        "intake_missing_iff_gap": "(intake IS NULL) <> is_imputed", "intake_not_negative": "intake < 0",
        "release_missing_iff_gap": "(release IS NULL) <> is_imputed", "release_not_negative": "release < 0",
        "load_missing_only_at_first": "load IS NULL AND seen > 0", "load_flag_present": "is_imputed_load IS NULL", "load_not_negative": "load < 0",
    }
    return " UNION ALL ".join(
        f"""SELECT series_id, '{n}' AS "check", count(CASE WHEN {c} THEN 1 END) AS n_violations, count(CASE WHEN {c} THEN 1 END) = 0 AS passed
            FROM (SELECT *, lag(ds) OVER (PARTITION BY series_id ORDER BY pos) AS prev, count(load) OVER (PARTITION BY series_id ORDER BY pos) AS seen,
                  row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS place FROM {count_rows}) GROUP BY series_id"""
        for n, c in bad.items()
    )


GATE = _gate_sql("master")
add("expectation_gate", lambda w: quality.gate(w.master, w.engine), GATE)
add("expectation_gate_sizes", lambda w: quality.gate(
    w.master, w.engine,
    w.obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_real"))).filter(F.col("check").startswith("expected_")),
    """SELECT m.series_id, 'expected_n_real' AS "check", CAST(CASE WHEN m.n = o.n THEN 0 ELSE 1 END AS BIGINT) AS n_violations, m.n = o.n AS passed
    FROM (SELECT series_id, count(CASE WHEN NOT is_imputed THEN 1 END) AS n FROM master GROUP BY 1) m
    JOIN (SELECT series_id, count(*) AS n FROM obs GROUP BY 1) o ON o.series_id = m.series_id""")
add("audit_verdict", lambda w: quality.overall(quality.gate(w.master, w.engine)),
    f"""SELECT series_id, count(*) AS n_checks, count(CASE WHEN NOT passed THEN 1 END) AS n_failed, bool_and(passed) AS all_passed
    FROM ({GATE}) GROUP BY series_id""")
add("panel_conservation", lambda w: w.master.groupBy("series_id").agg(
        F.sum("intake").alias("arrivals"), F.sum("release").alias("departures")), """
    SELECT o_orderpriority AS series_id, CAST(count(*) AS BIGINT) AS arrivals, CAST(count(first_ship) AS BIGINT) AS departures
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
add("panel_conservation_by_nation", lambda w: w.master.groupBy("series_id").agg(
        F.sum("intake").alias("arrivals"), F.sum("release").alias("departures")), """
    SELECT CAST(c_nationkey AS VARCHAR) AS series_id, CAST(count(*) AS BIGINT) AS arrivals, CAST(count(first_ship) AS BIGINT) AS departures
    FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""", key="nation")
add("master_series_five_day", lambda w: w.master, "SELECT * FROM f_master", engine=FIVE_DAY)
add("schedule_gaps", lambda w: quality.schedule_gaps(w.raw, w.engine), """
    WITH full_span AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds
        FROM (SELECT series_id, min(ds) AS a, max(ds) AS b FROM daily GROUP BY 1)),
    expected AS (SELECT * FROM full_span WHERE isodow(ds) - 1 IN (0, 1, 2, 3, 4, 5, 6))
    SELECT series_id, ds, 'gap' AS finding FROM (SELECT series_id, ds FROM expected EXCEPT SELECT series_id, ds FROM daily)
    UNION ALL SELECT series_id, ds, 'off_schedule' FROM (SELECT series_id, ds FROM daily EXCEPT SELECT series_id, ds FROM expected)""")
add("schedule_summary", lambda w: quality.schedule_summary(w.raw, w.engine), """
    SELECT o.series_id, o.n AS n_observed, t.n - o.on_template AS gap_count, o.n - o.on_template AS off_schedule_count
    FROM (SELECT series_id, count(*) AS n, count(CASE WHEN isodow(ds) - 1 IN (0, 1, 2, 3, 4, 5, 6) THEN 1 END) AS on_template FROM daily GROUP BY 1) o
    JOIN (SELECT series_id, count(*) AS n FROM (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
          FROM daily GROUP BY series_id) WHERE isodow(ds) - 1 IN (0, 1, 2, 3, 4, 5, 6) GROUP BY 1) t ON t.series_id = o.series_id""")
add("nulls_and_duplicates", lambda w: quality.nulls_and_duplicates(
        w.raw.unionByName(w.raw.filter(F.dayofmonth("ds") == 1)), ["series_id", "ds"]).select(
        *[F.col(c).cast("bigint").alias(c) if c != "series_id" else F.col(c) for c in (
            "series_id", "n_rows", "nulls_intake", "nulls_release", "nulls_load", "duplicate_dates", "duplicate_rows")]), """
    WITH rows AS (SELECT * FROM daily UNION ALL SELECT * FROM daily WHERE day(ds) = 1)
    SELECT series_id, count(*) AS n_rows, count(*) - count(intake) AS nulls_intake, count(*) - count(release) AS nulls_release,
        count(*) - count(load) AS nulls_load, count(*) - count(DISTINCT ds) AS duplicate_dates,
        count(*) - count(DISTINCT (ds, intake, release, load)) AS duplicate_rows FROM rows GROUP BY series_id""")
add("column_profile", lambda w: quality.column_profile(w.panel), """
    SELECT series_id, metric, count(value) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
        max(value) / nullif(min(value), 0) AS range_ratio, count(CASE WHEN value = 0 THEN 1 END) AS n_zero, count(CASE WHEN value < 0 THEN 1 END) AS n_negative
    FROM panel WHERE NOT is_imputed GROUP BY 1, 2""", "min max mean std range_ratio")
add("data_dictionary", lambda w: quality.data_dictionary(w.panel, w.engine), """
    SELECT metric, kind, count(value) AS n_present, count(CASE WHEN NOT is_imputed THEN value END) AS n_reported, min(value) AS min, max(value) AS max,
        avg(value) AS mean, CASE kind WHEN 'stock' THEN 'interpolated_and_flagged' ELSE 'left_missing' END AS missing_handling,
        CASE WHEN metric IN ('load', 'release') THEN 'target' ELSE 'component' END AS role
    FROM panel GROUP BY metric, kind""", "min max mean")
add("weekday_distribution", lambda w: quality.weekday_distribution(w.raw), """
    SELECT series_id, CAST(isodow(ds) - 1 AS INTEGER) AS weekday, strftime(ds, '%a') AS label, count(*) AS n FROM daily GROUP BY 1, 2, 3""")
add("sort_direction", lambda w: quality.sort_direction(w.master, "pos"),
    "SELECT series_id, true AS ascending, count(*) = 1 AS descending, count(*) = count(DISTINCT ds) AS \"unique\" FROM master GROUP BY 1")
add("flow_identity", lambda w: quality.flow_identity(w.obs, w.engine), """
    SELECT series_id, count(r) AS n_checked, count(CASE WHEN r = 0 THEN 1 END) AS n_exact, avg(CASE WHEN r = 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0 END) * 100 AS pct_exact,
        quantile_cont(r, 0.5) AS median, avg(r) AS mean, min(r) AS min, max(r) AS max, stddev_pop(r) AS std
    FROM (SELECT series_id, CAST(load - (lag(load) OVER (PARTITION BY series_id ORDER BY ds) + intake - release) AS DOUBLE) AS r FROM obs)
    GROUP BY 1""", "pct_exact median mean min max std")
add("flow_reconciliation", lambda w: quality.reconciliation(w.master, w.engine), """
    SELECT series_id, count(r) AS n_testable, count(CASE WHEN r = 0 THEN 1 END) AS n_exact, avg(CASE WHEN r = 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0 END) * 100 AS pct_exact,
        quantile_cont(abs(r), 0.5) AS median_abs, avg(r) AS mean_signed
    FROM (SELECT a.series_id, CASE WHEN NOT a.is_imputed_load AND NOT b.is_imputed_load THEN CAST(a.load - (b.load + a.intake - a.release) AS DOUBLE) END AS r
          FROM master a LEFT JOIN master b ON b.series_id = a.series_id AND b.pos = a.pos - 1) GROUP BY 1""", "pct_exact median_abs mean_signed")
add("regime_range", lambda w: quality.regime(w.panel), """
    SELECT series_id, metric, max(value) AS max, min(value) AS min, max(value) / nullif(min(value), 0) AS ratio,
        arg_max(value, pos) FILTER (WHERE value IS NOT NULL) AS last,
        min(CASE WHEN value = hi THEN ds END) AS peak_ds, min(CASE WHEN value = lo THEN ds END) AS trough_ds
    FROM (SELECT *, max(value) OVER s AS hi, min(value) OVER s AS lo FROM panel WINDOW s AS (PARTITION BY series_id, metric)) GROUP BY 1, 2""",
    "max min ratio last")
add("forward_calendar", lambda w: calendar.forward_calendar(w.master, w.engine), """
    SELECT series_id, CAST(last_pos + rn AS INTEGER) AS pos, ds, CAST(rn AS INTEGER) AS steps_ahead FROM (
        SELECT series_id, last_pos, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn FROM (
            SELECT series_id, max(pos) AS last_pos, CAST(unnest(generate_series(max(ds) + INTERVAL 1 DAY, max(ds) + INTERVAL 120 DAY, INTERVAL 1 DAY)) AS DATE) AS ds
            FROM master GROUP BY series_id) WHERE isodow(ds) - 1 IN (0, 1, 2, 3, 4, 5, 6)) WHERE rn <= 14""")
add("series_bounds", lambda w: w.bounds, "SELECT * FROM bounds")
add("boundary_problems", lambda w: calendar.require_boundaries(w.bounds),
    "SELECT series_id, cutoff_pos IS NULL AS cap_after_series_end, holdout_start_pos IS NULL AS too_few_real_slots FROM bounds")
add("cutoff_position_fixed_date", lambda w: calendar.series_bounds(w.master, w.engine, "2000-01-01").select("series_id", "cutoff_pos"),
    "SELECT series_id, min(CASE WHEN ds >= DATE '2000-01-01' THEN pos END) AS cutoff_pos FROM master GROUP BY 1")
add("raw_to_clean", lambda w: quality.raw_to_clean(w.raw, w.master, w.engine), """
    SELECT d.series_id, count(*) AS n_raw, count(CASE WHEN m.ds IS NULL THEN 1 END) AS n_lost_dates,
        count(CASE WHEN m.intake <> d.intake THEN 1 END) AS n_changed_intake, count(CASE WHEN m.release <> d.release THEN 1 END) AS n_changed_release,
        count(CASE WHEN m.load <> d.load THEN 1 END) AS n_changed_load
    FROM daily d LEFT JOIN master m ON m.series_id = d.series_id AND m.ds = d.ds GROUP BY 1""")
add("zero_listing", lambda w: quality.zero_listing(w.panel, w.engine), """
    SELECT f.series_id, f.metric, f.n_zero, z.ds, strftime(z.ds, '%A') AS weekday, strftime(z.ds, '%B') AS month
    FROM (SELECT series_id, metric, count(CASE WHEN NOT is_imputed AND value = 0 THEN 1 END) AS n_zero FROM panel WHERE kind = 'flow' GROUP BY 1, 2) f
    LEFT JOIN panel z ON z.series_id = f.series_id AND z.metric = f.metric AND NOT z.is_imputed AND z.value = 0""")

# ================================================================= features
add("net_flow", lambda w: imbalance.net_flow(w.master, w.engine), "SELECT series_id, ds, pos, intake - release AS net_flow FROM master")
SOURCES = ("intake", "release", "load", "net_flow")
SOURCE_ROWS = "(SELECT *, intake - release AS net_flow FROM master)"
LAGS = [f"lag_{k}_{c}" for c in SOURCES for k in (1, 7, 14)]
add("lag_features", lambda w: features.lag_and_rolling(w.master, w.engine).select("series_id", "pos", *LAGS),
    "SELECT a.series_id, a.pos, " + ", ".join(f"CAST(l{k}.{c} AS DOUBLE) AS lag_{k}_{c}" for c in SOURCES for k in (1, 7, 14))
    + f" FROM {SOURCE_ROWS} a " + " ".join(
        f"LEFT JOIN {SOURCE_ROWS} l{k} ON l{k}.series_id = a.series_id AND l{k}.pos = a.pos - {k}" for k in (1, 7, 14)),
    " ".join(LAGS))
ROLLS = [f"rolling_{k}_{s}_{c}" for c in SOURCES for k in (7, 14) for s in ("mean", "var", "nobs")]
# variances of the level reach 1e10, where six decimals exceed double precision
add("rolling_features", lambda w: features.lag_and_rolling(w.master, w.engine).select(
        "series_id", "pos", *[F.round(F.col(c) + 1e-4).cast("bigint").alias(c) if c.endswith("var_load") else F.col(c) for c in ROLLS]),
    "SELECT series_id, pos, " + ", ".join(
        f"avg({c}) OVER w{k} AS rolling_{k}_mean_{c}, {"CAST(round(var_samp(load) OVER w%d + 1e-4) AS BIGINT)" % k if c == "load" else f"var_samp({c}) OVER w{k}"} AS rolling_{k}_var_{c}, CAST(count({c}) OVER w{k} AS DOUBLE) AS rolling_{k}_nobs_{c}"
        for c in SOURCES for k in (7, 14))
    + f" FROM {SOURCE_ROWS} WINDOW " + ", ".join(
        f"w{k} AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (7, 14)),
    " ".join(c for c in ROLLS if not c.endswith("var_load")))

FIRST = "make_date(y, {m}, 1)"
NTH = "CAST(make_date(y, {m}, 1) + CAST((({d} - isodow(make_date(y, {m}, 1))) % 7 + 7) % 7 + 7 * ({n} - 1) AS INTEGER) AS DATE)"
FIXED = [("New Year''s Day", 1, 1, 0), ("Juneteenth National Independence Day", 6, 19, 2021), ("Independence Day", 7, 4, 0),
         ("Veterans Day", 11, 11, 0), ("Christmas Day", 12, 25, 0)]
MOVABLE = [("Martin Luther King Jr. Day", 1, 1, 3), ("Washington''s Birthday", 2, 1, 3), ("Labor Day", 9, 1, 1),
           ("Columbus Day", 10, 1, 2), ("Thanksgiving", 11, 4, 4)]


def _holiday_sql(years: str) -> str:
    parts = []
    for n, m, d, since in FIXED:
        day = f"make_date(y, {m}, {d})"
        parts.append(f"SELECT y, '{n}' AS holiday, {day} AS ds FROM {years} WHERE y >= {since}")
        parts.append(f"SELECT y, '{n} (observed)', CAST(CASE isodow({day}) WHEN 6 THEN {day} - 1 WHEN 7 THEN {day} + 1 ELSE {day} END AS DATE) FROM {years} WHERE y >= {since}")
    for n, m, d, k in MOVABLE:
        parts.append(f"SELECT y, '{n}', {NTH.format(m=m, d=d, n=k)} FROM {years}")
    parts.append(f"SELECT y, 'Memorial Day', CAST(make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) AS DATE) FROM {years}")
    return "SELECT CAST(y AS INTEGER) AS year, min(holiday) AS holiday, ds FROM (" + " UNION ALL ".join(parts) + ") GROUP BY y, ds"


YEARS = "(SELECT unnest(range(min(year(ds)) - 1, max(year(ds)) + 2)) AS y FROM master)"


def _holidays(w: Workspace) -> DataFrame:
    span = w.master.agg(F.min(F.year("ds")).alias("a"), F.max(F.year("ds")).alias("b"))
    return holidays(span.select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("year")))


add("holiday_table", _holidays, _holiday_sql(YEARS))
add("calendar_features", lambda w: features.calendar_features(w.master, w.engine).select(
        "series_id", "pos", "ds", "day_of_week", "month", "is_near_holiday"), f"""
    WITH hol AS ({_holiday_sql(YEARS)})
    SELECT m.series_id, m.pos, m.ds, CAST(isodow(m.ds) - 1 AS INTEGER) AS day_of_week, CAST(month(m.ds) AS INTEGER) AS month,
        CAST(CASE WHEN EXISTS (SELECT 1 FROM hol h WHERE abs(date_diff('day', h.ds, m.ds)) <= 2) THEN 1 ELSE 0 END AS INTEGER) AS is_near_holiday
    FROM master m""")
COMPLETE = " AND ".join(
    [f"lag(x_{c}, {k}) OVER w IS NOT NULL" for c in SOURCES for k in (1, 7, 14)]
    + [f"count(x_{c}) OVER w{k} >= 2" for c in SOURCES for k in (7, 14)])
FEATURES_COMPLETE = f"""SELECT series_id, pos, {COMPLETE} AS complete
    FROM (SELECT series_id, pos, intake AS x_intake, release AS x_release, load AS x_load, intake - release AS x_net_flow FROM master)
    WINDOW w AS (PARTITION BY series_id ORDER BY pos), w7 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
        w14 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"""
O.block("complete_rows", FEATURES_COMPLETE)
add("incomplete_feature_rows", lambda w: features.incomplete_rows(w.features, w.engine),
    "SELECT series_id, count(*) AS n_rows, count(CASE WHEN NOT complete THEN 1 END) AS n_incomplete FROM complete_rows WHERE pos >= 14 GROUP BY 1")
add("first_differences", lambda w: features.differences(w.panel).select("series_id", "metric", "pos", "diff"), """
    SELECT series_id, metric, pos, value - lag(value) OVER (PARTITION BY series_id, metric ORDER BY pos) AS diff FROM panel WHERE value IS NOT NULL""", "diff")
add("centred_mean", lambda w: features.centred_mean(w.panel), """
    SELECT a.series_id, a.metric, a.pos, CASE WHEN count(b.value) = 30 THEN avg(b.value) END AS centred_mean
    FROM panel a LEFT JOIN panel b ON b.series_id = a.series_id AND b.metric = a.metric AND b.pos BETWEEN a.pos - 15 AND a.pos + 14
    GROUP BY 1, 2, 3""", "centred_mean")
add("detrended", lambda w: features.detrended(w.panel), """
    SELECT series_id, metric, pos, value - avg(value) OVER (PARTITION BY series_id, metric ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS detrended
    FROM panel WHERE value IS NOT NULL""", "detrended")
add("gap_flags", lambda w: folds.gap_flags(w.master),
    "SELECT series_id, ds, pos, is_imputed, adjacent AS adjacent_to_gap FROM flagged")
add("history_tail", lambda w: imbalance.tail(w.master.select("series_id", "pos", "ds", "load"), 90),
    "SELECT series_id, pos, ds, load FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS rn FROM master) WHERE rn <= 90")
add("history_tail_to_origin", lambda w: imbalance.tail(
        w.master.select("series_id", "pos", "ds", "load"), 60, w.bounds.select("series_id", F.col("dev_end_pos").alias("origin_pos"))
    ).select("series_id", "pos", "ds", "load"),
    "SELECT m.series_id, m.pos, m.ds, m.load FROM master m JOIN bounds b ON b.series_id = m.series_id AND m.pos BETWEEN b.dev_end_pos - 59 AND b.dev_end_pos")

# ================================================================= folds and forecasts
add("fold_manifest", lambda w: folds.fold_manifest(w.folds, w.engine), MANIFEST.format(t="folds"))
add("holdout_folds", lambda w: folds.fold_manifest(w.holdout_folds, w.engine), MANIFEST.format(t="hfolds"))
add("training_cutoff", lambda w: folds.training_cutoff(w.master), "SELECT series_id, pos, train_cutoff_pos FROM flagged")
add("leakage_checks", lambda w: folds.leakage_checks(w.folds, w.bounds, w.master), " UNION ALL ".join(
    f"""SELECT '{n}' AS "check", count(*) AS n_folds, count(CASE WHEN NOT ({c}) THEN 1 END) AS n_violations, count(CASE WHEN NOT ({c}) THEN 1 END) = 0 AS passed
        FROM (SELECT f.series_id, fold_id, origin_pos, f.train_cutoff_pos, dev_end_pos, g.is_imputed AS gap, min(test_pos) AS a, max(test_pos) AS b
              FROM folds f JOIN master g ON g.series_id = f.series_id AND g.pos = f.train_cutoff_pos GROUP BY 1, 2, 3, 4, 5, 6)"""
    for n, c in {"origin_before_tests": "origin_pos < a", "tests_before_holdout": "b <= dev_end_pos",
                 "cutoff_not_after_origin": "train_cutoff_pos <= origin_pos", "cutoff_is_real": "NOT gap"}.items()))
WINDOW_COLUMNS = ("series_id, metric, fold_id, window_rule, origin_pos, train_start_pos, train_cutoff_pos, train_n_positions, "
                  "train_n_usable, fallback_applied, flips_at_upper_floor, origin_post_cutoff, mase_scale")
add("training_windows", lambda w: w.windows.select(*WINDOW_COLUMNS.split(", ")), f"SELECT DISTINCT {WINDOW_COLUMNS} FROM req", "mase_scale")
add("mase_scale", lambda w: w.state.select("series_id", "metric", "train_cutoff_pos", "mase_scale"), """
    SELECT s.series_id, s.metric, s.pos AS train_cutoff_pos, nullif(avg(j.jump), 0) AS mase_scale
    FROM panel s LEFT JOIN jumps j ON j.series_id = s.series_id AND j.metric = s.metric AND j.pos <= s.pos GROUP BY 1, 2, 3""", "mase_scale")

FACT = [c for c in harness.COLUMNS if c not in ("y_pred_lo", "y_pred_hi")] + ["common_support"]
FACT_DOUBLES = "y_true y_pred mase_scale"


def _model(name: str) -> Callable[[Workspace], DataFrame]:
    keep = ["series_id", "metric", "window_rule", "fold_id", "horizon", "effective_lead", "y_pred"]
    return lambda w: w.predictions.filter(F.col("model") == name).select(*keep)


for _name in CHECKED_MODELS:
    add(f"forecast_{_name}" + ("_level" if _name == "exponential_smoothing" else ""), _model(_name),
        f"SELECT series_id, metric, window_rule, fold_id, horizon, effective_lead, y_pred FROM pred WHERE model = '{_name}'", "y_pred")
add("walk_forward_predictions", lambda w: w.predictions.select(*FACT), "SELECT * FROM pred", FACT_DOUBLES)
add("walk_forward_hourly", lambda w: w.predictions.select(*FACT), "SELECT * FROM e_pred", FACT_DOUBLES,
    key="events", engine=HOURLY)
add("metrics_by_nation", lambda w: scoring.metrics_matrix(w.predictions), O.measures("n_pred", O.CELL),
    "MAE RMSE MAPE sMAPE MASE ME_bias", key="nation")
add("metrics_hourly", lambda w: scoring.metrics_matrix(w.predictions), O.measures("e_pred", O.CELL),
    "MAE RMSE MAPE sMAPE MASE ME_bias", key="events", engine=HOURLY)


def _candidate_run(w: Workspace) -> DataFrame:
    """Two separate runs over the same folds, stacked, support over the union."""
    one = harness.forecasts(w.requests, w.panel, w.engine, ("naive", "moving_average"))
    two = harness.forecasts(w.requests, w.panel, w.engine, ("seasonal_naive",))
    return harness.with_common_support(harness.stack(one, two)).select(
        "series_id", "metric", "model", "window_rule", "fold_id", "horizon", "y_pred", "common_support")


add("candidate_run", _candidate_run, """
    SELECT series_id, metric, model, window_rule, fold_id, horizon, y_pred,
        bool_and(y_true IS NOT NULL AND y_pred IS NOT NULL AND y_true_is_observed) OVER (PARTITION BY series_id, metric, window_rule, fold_id, horizon) AS common_support
    FROM pred WHERE model <> 'exponential_smoothing'""", "y_pred")


def _pairs_sql(complete: bool) -> str:
    usable = "l.value IS NOT NULL" + (" AND c.complete" if complete else "")
    return f"""
        WITH asked AS (SELECT DISTINCT series_id, metric, fold_id, window_rule, train_start_pos, train_cutoff_pos, horizon, effective_lead FROM req
                       WHERE metric <> 'intake')
        SELECT a.*, count(l.pos) AS n_candidates, count(CASE WHEN {usable} THEN 1 END) AS n_pairs,
            count(l.pos) - count(CASE WHEN {usable} THEN 1 END) AS n_dropped
        FROM asked a
        LEFT JOIN panel l ON l.series_id = a.series_id AND l.metric = a.metric AND l.pos BETWEEN a.train_start_pos + a.effective_lead AND a.train_cutoff_pos
        LEFT JOIN complete_rows c ON c.series_id = l.series_id AND c.pos = l.pos - a.effective_lead
        GROUP BY ALL"""


def _pairs(complete: bool) -> Callable[[Workspace], DataFrame]:
    keep = ["series_id", "metric", "fold_id", "window_rule", "train_start_pos", "train_cutoff_pos", "horizon", "effective_lead"]
    return lambda w: features.training_pairs(
        w.features, w.targets,
        w.requests.filter(F.col("metric").isin(*w.engine.targets)).select(*keep),
        "effective_lead", complete)


add("training_pairs_complete_rows", _pairs(True), _pairs_sql(True))
add("training_pairs_all_rows", _pairs(False), _pairs_sql(False))

FITTED = ["series_id", "metric", "model", "window_rule", "fold_id", "horizon", "effective_lead", "y_true", "y_pred",
          "y_pred_lo", "y_pred_hi", "fit_failed", "forecast_failed", "failure_reason"]
FULL_ENGINE = CHECKED.with_(smoothing=Engine().smoothing)


def _statistical(model: str) -> Callable[[Workspace], DataFrame]:
    def plan(w: Workspace) -> DataFrame:
        targets = w.requests.filter(F.col("metric").isin(*w.engine.targets))
        return harness.forecasts(targets, w.panel, w.engine, (model,))
    return plan


add("forecast_exponential_smoothing_seasonal", lambda w: _statistical("exponential_smoothing")(w).select(*FITTED),
    f"SELECT {', '.join(FITTED)} FROM hw_pred", "y_true y_pred y_pred_lo y_pred_hi", engine=FULL_ENGINE)


def _smoothing_parameters(w: Workspace) -> DataFrame:
    return w.smoothing_fits.select(*smoothing.KEYS, "n_finite", "alpha", "beta", "gamma", "phi", "level", "slope", F.sqrt(F.col("sse") / F.greatest(F.col("n_finite") - F.size("seasonal"), F.lit(1))).alias("residual_sd"))


add("smoothing_parameters", _smoothing_parameters, """
    SELECT DISTINCT series_id, metric, train_start_pos, n AS n_finite, z.alpha AS alpha, z.beta AS beta, z.gamma AS gamma, z.phi AS phi, z.level AS level,
        z.slope AS slope, sqrt(z.sse / greatest(n - len(z.s), 1)) AS residual_sd FROM hw_best""", "alpha beta gamma phi level slope residual_sd", engine=FULL_ENGINE)
add("forecast_sarima", lambda w: w.sarima.select(*FITTED, "fit_status"), engine=FULL_ENGINE)
add("sarima_parameters", lambda w: w.sarima.select(
    "series_id", "metric", "train_start_pos", "train_cutoff_pos", "fit_status", "n_residuals", "residual_sd", F.array_join(F.transform(
        "parameters", lambda x: F.format_number(x, 6)), ",").alias("parameters")).distinct(), engine=FULL_ENGINE)
add("native_interval_coverage", lambda w: scoring.native_coverage(_statistical("exponential_smoothing")(w), w.engine), """
    SELECT series_id, metric, model, horizon, count(*) AS n, avg(CAST(y_true BETWEEN y_pred_lo AND y_pred_hi AS INTEGER)) * 100 AS empirical_coverage_pct,
        quantile_cont(y_pred_hi - y_pred_lo, 0.5) AS median_width, 95.0::DOUBLE AS nominal_pct
    FROM hw_pred WHERE window_rule = 'full' AND y_pred_lo IS NOT NULL AND observed AND y_true IS NOT NULL GROUP BY ALL""",
    "empirical_coverage_pct median_width nominal_pct", engine=FULL_ENGINE)


def _learned_plan(family: str) -> Callable[[Workspace], DataFrame]:
    return lambda w: w.learned(family).select(*FITTED)


add("forecast_random_forest", _learned_plan("random_forest"), engine=FULL_ENGINE)
add("forecast_gradient_boosting", _learned_plan("gradient_boosting"), engine=FULL_ENGINE)
add("feature_importances", lambda w: learned.importances(w.learned_fits("random_forest")), engine=FULL_ENGINE)
add("top_features_own_share", lambda w: learned.own_share(learned.top_features(
    learned.importances(w.learned_fits("random_forest")))), engine=FULL_ENGINE)
add("family_winners", lambda w: w.pairs, "SELECT * FROM pairs")
add("ensemble_forecasts", lambda w: w.ensemble.select(
        "series_id", "metric", "model", "window_rule", "fold_id", "horizon", "y_true", "y_pred", "ensemble_components"),
    "SELECT series_id, metric, model, window_rule, fold_id, horizon, y_true, y_pred, ensemble_components FROM ens", "y_true y_pred")

# ================================================================= scoring
MATRIX = "MAE RMSE MAPE sMAPE MASE ME_bias"
add("metrics_matrix", lambda w: scoring.metrics_matrix(w.predictions), O.measures("pred", O.CELL), MATRIX)
add("metrics_pooled", lambda w: scoring.pooled_metrics(w.predictions), O.measures("pred", "metric, model, window_rule, horizon"), MATRIX)
add("metrics_all_actuals", lambda w: scoring.metrics_matrix(w.predictions, only_observed=False).select(*O.CELL.split(", "), "n_scored", "n_total", "MAE"), """
    SELECT series_id, metric, model, window_rule, horizon, count(CASE WHEN y_true IS NOT NULL AND y_pred IS NOT NULL THEN 1 END) AS n_scored,
        count(*) AS n_total, avg(abs(y_true - y_pred)) AS MAE FROM pred GROUP BY 1, 2, 3, 4, 5""", "MAE")
add("scoped_metrics", lambda w: w.metrics, "SELECT * FROM metrics", MATRIX)
add("single_scale_mase", lambda w: w.predictions.filter("y_true_is_observed").groupBy("series_id", "metric", "model").agg(
        S.mase(F.col("y_true"), F.col("y_pred"), F.col("mase_scale")).alias("MASE")),
    "SELECT series_id, metric, model, avg(abs(y_true - y_pred)) / max(CASE WHEN mase_scale > 0 THEN mase_scale END) AS MASE FROM pred WHERE y_true_is_observed GROUP BY 1, 2, 3", "MASE")
add("common_support", lambda w: w.predictions.groupBy("series_id", "metric", "window_rule", "horizon").agg(
        F.count_if("common_support").alias("n_supported"), F.count(F.lit(1)).alias("n_rows")),
    """SELECT series_id, metric, window_rule, horizon, count(CASE WHEN common_support THEN 1 END) AS n_supported, count(*) AS n_rows
    FROM pred GROUP BY 1, 2, 3, 4""")
add("baseline_gate", lambda w: scoring.gate(
        w.metrics.filter("fold_scope = 'post_cutoff_common_support'"), ("moving_average", "exponential_smoothing")), """
    SELECT * FROM (SELECT series_id, metric, window_rule, horizon, model, MAE, MAE_naive, MAE_seasonal_naive, coalesce(MAE < least(MAE_naive, MAE_seasonal_naive), false) AS beats_both_baselines,
        CASE WHEN least(MAE_naive, MAE_seasonal_naive) > 0 THEN (1 - MAE / least(MAE_naive, MAE_seasonal_naive)) * 100 END AS skill_vs_best_baseline_pct
    FROM (SELECT *, max(CASE WHEN model = 'naive' THEN MAE END) OVER c AS MAE_naive, max(CASE WHEN model = 'seasonal_naive' THEN MAE END) OVER c AS MAE_seasonal_naive
          FROM metrics WHERE fold_scope = 'post_cutoff_common_support' WINDOW c AS (PARTITION BY series_id, metric, window_rule, horizon))
    WHERE model IN ('moving_average', 'exponential_smoothing') AND least(MAE_naive, MAE_seasonal_naive) IS NOT NULL)""",
    "MAE MAE_naive MAE_seasonal_naive skill_vs_best_baseline_pct")
add("residuals", lambda w: scoring.residuals(w.predictions), f"SELECT {O.RESID} FROM pred WHERE {O.SCORABLE}", "y_true y_pred residual abs_residual")
add("residuals_with_ensemble", lambda w: w.residuals, "SELECT * FROM resid", "y_true y_pred residual abs_residual")
add("residual_counts", lambda w: scoring.residual_counts(w.residuals, w.engine), """
    SELECT series_id, metric, model, count(CASE WHEN horizon = 1 THEN 1 END) AS n_h1, count(CASE WHEN horizon = 7 THEN 1 END) AS n_h7,
        count(CASE WHEN horizon = 14 THEN 1 END) AS n_h14 FROM resid WHERE origin_post_cutoff GROUP BY 1, 2, 3""")
add("abstentions", lambda w: scoring.abstentions(w.predictions), """
    SELECT series_id, metric, model, count(*) AS rows, count(*) - count(y_true) AS actual_missing,
        count(CASE WHEN NOT y_true_is_observed THEN y_true END) AS actual_interpolated_excluded, count(*) - count(y_pred) AS forecast_abstained
    FROM pred GROUP BY 1, 2, 3""")
CONTAM = """
    SELECT *, CASE WHEN MAE_all_folds > 0 THEN (MAE_clean - MAE_all_folds) / MAE_all_folds * 100 END AS MAE_shift_pct_if_dropped
    FROM (SELECT series_id, metric, model, horizon, avg(e) AS MAE_all_folds, count(CASE WHEN NOT row_gap_adjacent THEN y_true END) AS n_clean,
            avg(CASE WHEN NOT row_gap_adjacent THEN e END) AS MAE_clean, count(CASE WHEN row_gap_adjacent THEN y_true END) AS n_flagged,
            avg(CASE WHEN row_gap_adjacent THEN e END) AS MAE_flagged, avg(CASE WHEN NOT row_gap_adjacent THEN s END) * 100 AS sMAPE_clean,
            avg(CASE WHEN row_gap_adjacent THEN s END) * 100 AS sMAPE_flagged
          FROM (SELECT *, abs(y_true - y_pred) AS e, CASE WHEN y_true = 0 AND y_pred = 0 THEN 0 ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END AS s
                FROM pred WHERE window_rule = 'full' AND y_true_is_observed) GROUP BY 1, 2, 3, 4)"""
add("contamination_sensitivity", lambda w: scoring.contamination(w.predictions), CONTAM,
    "MAE_all_folds MAE_clean MAE_flagged sMAPE_clean sMAPE_flagged MAE_shift_pct_if_dropped")
add("largest_contamination_shift", lambda w: scoring.largest_shift(scoring.contamination(w.predictions)),
    f"SELECT series_id, metric, max(abs(MAE_shift_pct_if_dropped)) AS max_abs_shift_pct FROM ({CONTAM}) GROUP BY 1, 2", "max_abs_shift_pct")
FITS = """(SELECT series_id, metric, model, window_rule, fold_id, bool_or(fit_failed) AS fit_failed, max(failure_reason) AS failure_reason FROM {t} GROUP BY 1, 2, 3, 4, 5)"""
add("fit_reliability", lambda w: scoring.fit_reliability(w.predictions), f"""
    SELECT metric, model, count(*) AS fits_attempted, count(CASE WHEN fit_failed THEN 1 END) AS fits_failed,
        100 * (1 - count(CASE WHEN fit_failed THEN 1 END) / count(*)) AS success_rate_pct FROM {FITS.format(t="pred")} GROUP BY 1, 2""", "success_rate_pct")
add("failure_reasons", lambda w: scoring.failure_reasons(w.predictions), f"""
    SELECT model, failure_reason, count(*) AS folds FROM {FITS.format(t="pred")} WHERE fit_failed GROUP BY 1, 2""")
add("window_rule_effect", lambda w: scoring.rule_effect(w.predictions), """
    SELECT series_id, metric, model, count(*) AS comparable_rows, count(CASE WHEN g = 0 THEN 1 END) AS identical, count(CASE WHEN g > 0 THEN 1 END) AS differing,
        quantile_cont(g, 0.5) AS median_abs_diff, max(g) AS max_abs_diff
    FROM (SELECT a.series_id, a.metric, a.model, abs(a.y_pred - b.y_pred) AS g FROM pred a JOIN pred b ON b.series_id = a.series_id AND b.metric = a.metric
              AND b.model = a.model AND b.fold_id = a.fold_id AND b.horizon = a.horizon AND b.window_rule = 'capped'
          WHERE a.window_rule = 'full' AND a.y_pred IS NOT NULL AND b.y_pred IS NOT NULL) GROUP BY 1, 2, 3""", "median_abs_diff max_abs_diff")
add("cap_fallback_summary", lambda w: scoring.cap_summary(w.predictions), """
    SELECT series_id, metric, count(DISTINCT fold_id) AS post_cutoff_folds, count(DISTINCT CASE WHEN fallback_applied THEN fold_id END) AS fell_back,
        count(DISTINCT CASE WHEN flips_at_upper_floor THEN fold_id END) AS would_flip,
        count(DISTINCT fold_id) - count(DISTINCT CASE WHEN fallback_applied THEN fold_id END) AS genuinely_capped
    FROM pred WHERE window_rule = 'capped' AND origin_post_cutoff GROUP BY 1, 2""")
O.block("late", f"""
    SELECT e.*, EXISTS (SELECT 1 FROM pred p WHERE p.common_support AND p.series_id = e.series_id AND p.metric = e.metric
        AND p.window_rule = e.window_rule AND p.fold_id = e.fold_id AND p.horizon = e.horizon) AS common_support
    FROM (SELECT {O.PRED_COLUMNS} FROM ens) e""")
O.block("late_scoped", O.scopes("late"))
add("complete_matrix", lambda w: scoring.complete_matrix(w.predictions, w.ensemble),
    "SELECT * FROM metrics UNION ALL " + O.measures("late_scoped", f"fold_scope, {O.CELL}"), MATRIX)
add("target_diagnostics", lambda w: scoring.target_diagnostics(w.predictions), """
    SELECT series_id, metric, count(CASE WHEN y_true_is_observed AND y_true = 0 THEN 1 END) AS zero_actuals, min(CASE WHEN y_true_is_observed THEN y_true END) AS min_actual,
        avg(CASE WHEN y_true_is_observed THEN CASE WHEN y_true < 10 THEN 1.0::DOUBLE ELSE 0 END END) * 100 AS pct_below_10 FROM pred GROUP BY 1, 2""", "min_actual pct_below_10")
GOVERNING = "SELECT * FROM cmetrics WHERE fold_scope = 'post_cutoff_common_support' AND window_rule = 'capped'"
add("worst_models", lambda w: scoring.worst_models(w.governing_cells), f"""
    SELECT metric, model, count(*) AS cells_worst FROM (SELECT *, row_number() OVER (PARTITION BY series_id, metric, horizon ORDER BY MAE DESC, model) AS rn
        FROM ({GOVERNING}) WHERE MAE IS NOT NULL) WHERE rn = 1 GROUP BY 1, 2""")
FAMILY = """CASE WHEN {m} IN ('naive', 'seasonal_naive', 'moving_average') THEN 'baseline' WHEN {m} IN ('sarima', 'exponential_smoothing') THEN 'statistical'
    WHEN {m} IN ('random_forest', 'gradient_boosting') THEN 'machine learning' ELSE 'ensemble' END"""
add("comparison_view", lambda w: scoring.comparison_view(w.governing_cells), f"""
    SELECT series_id, metric, window_rule, horizon, model, {FAMILY.format(m="model")} AS family, n_scored, MAE, RMSE, MAPE, sMAPE, MASE, ME_bias,
        CASE WHEN model NOT IN ('naive', 'seasonal_naive', 'moving_average') THEN coalesce(MAE < min(CASE WHEN model IN ('naive', 'seasonal_naive') THEN MAE END) OVER c, false) END AS beats_both_baselines,
        CAST(row_number() OVER (PARTITION BY series_id, metric, window_rule, horizon ORDER BY MAE NULLS LAST, model) AS INTEGER) AS rank
    FROM ({GOVERNING}) WINDOW c AS (PARTITION BY series_id, metric, window_rule, horizon)""", MATRIX)
add("wins_by_family", lambda w: scoring.wins_by_family(w.champions),
    f"SELECT metric, {FAMILY.format(m='champion')} AS family, count(*) AS wins FROM champions WHERE champion IS NOT NULL GROUP BY 1, 2")
add("origin_overlap", lambda w: scoring.origin_overlap(w.predictions), """
    SELECT series_id, metric, count(*) AS n_positions, count(CASE WHEN n > 1 THEN 1 END) AS n_shared, avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END) AS share_shared
    FROM (SELECT series_id, metric, test_pos, count(DISTINCT origin_pos) AS n FROM pred GROUP BY 1, 2, 3) GROUP BY 1, 2""", "share_shared")

# ================================================================= selection
add("complexity_ranks", lambda w: w.combined.select("model").distinct().select(
        "model", selection.complexity_rank(F.col("model")).alias("rank")),
    f"SELECT DISTINCT model, CAST(list_position({O.ORDER}, model) - 1 AS INTEGER) AS rank FROM comb")
PAIRED = f"""
    SELECT a.series_id, a.metric, a.window_rule, a.fold_id, a.horizon, abs(a.y_true - a.y_pred) AS error_a, abs(b.y_true - b.y_pred) AS error_b,
        abs(a.y_true - b.y_true) < 1e-8 AS same_actual
    FROM (SELECT * FROM comb WHERE model = 'moving_average' AND {O.SCORABLE}) a JOIN (SELECT * FROM comb WHERE model = 'naive' AND {O.SCORABLE}) b
        ON b.series_id = a.series_id AND b.metric = a.metric AND b.window_rule = a.window_rule AND b.fold_id = a.fold_id AND b.horizon = a.horizon"""
add("paired_errors", lambda w: selection.paired_errors(w.combined, "moving_average", "naive"), PAIRED, "error_a error_b")
O.block("pair_rows", f"""
    SELECT series_id, metric, window_rule, horizon, error_a - error_b AS d,
        row_number() OVER (PARTITION BY series_id, metric, window_rule, horizon ORDER BY fold_id) - 1 AS i,
        count(*) OVER (PARTITION BY series_id, metric, window_rule, horizon) AS n FROM ({PAIRED})""")
O.block("pair_draws", O.draws("(SELECT DISTINCT n FROM pair_rows)"))
BOOT = """
    SELECT c.series_id, c.metric, c.window_rule, c.horizon, c.n, c.mean_difference, ci_low, ci_high,
        ci_low > 1e-9 * greatest(abs(ci_low), abs(ci_high)) OR ci_high < -1e-9 * greatest(abs(ci_low), abs(ci_high)) AS distinguishable, NOT (ci_low > 1e-9 * greatest(abs(ci_low), abs(ci_high)) OR ci_high < -1e-9 * greatest(abs(ci_low), abs(ci_high))) AS practically_equivalent
    FROM (SELECT series_id, metric, window_rule, horizon, count(*) AS n, avg(d) AS mean_difference FROM pair_rows GROUP BY 1, 2, 3, 4) c
    JOIN (SELECT series_id, metric, window_rule, horizon, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high
          FROM (SELECT p.series_id, p.metric, p.window_rule, p.horizon, w.rep, avg(p.d) AS m FROM pair_rows p JOIN pair_draws w ON w.n = p.n AND w.idx = p.i
                GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) b
        ON b.series_id = c.series_id AND b.metric = c.metric AND b.window_rule = c.window_rule AND b.horizon = c.horizon"""
add("paired_bootstrap", lambda w: selection.paired_bootstrap(selection.paired_errors(w.combined, "moving_average", "naive"), w.engine),
    BOOT, "mean_difference ci_low ci_high")
add("paired_bootstrap_numpy_draws", lambda w: selection.paired_bootstrap(
    selection.paired_errors(w.combined, "moving_average", "naive"), w.engine.with_(draws="numpy", resamples=10_000)))
add("bias_diagnostics", lambda w: selection.bias_diagnostics(
        selection.scope_points(w.combined, w.engine.selection_scope, w.engine), w.engine, ["series_id", "metric", "horizon", "model"]), """
    SELECT series_id, metric, horizon, model, n_points AS n, bias, MAE AS mae, bias_ratio, bias_low AS ci_low, bias_high AS ci_high, bias_significant AS significant
    FROM evid""", "bias mae bias_ratio ci_low ci_high")
add("stability_diagnostics", lambda w: selection.stability_diagnostics(
        selection.scope_points(w.combined, w.engine.selection_scope, w.engine), ["series_id", "metric", "horizon", "model"]), """
    SELECT series_id, metric, horizon, model, n_points AS n, error_median, error_iqr, error_p90, tail_ratio FROM evid""", "error_median error_iqr error_p90 tail_ratio")
EVIDENCE = ["series_id", "metric", "horizon", "model", "MAE", "n_points", "rank", "viable", "any_passed", "mean_difference", "diff_low", "diff_high",
            "distinguishable", "tied", "screened"]
add("candidate_evidence", lambda w: w.evidence.select(*EVIDENCE), f"SELECT {', '.join(EVIDENCE)} FROM tied", "MAE mean_difference diff_low diff_high")
CHAMPION = ["series_id", "metric", "horizon", "champion", "champion_mae", "numerical_leader", "numerical_leader_mae", "gate_cleared_by", "tied_with_best",
            "bias_screened_out", "n_scored", "reason"]
LISTS = ("gate_cleared_by", "tied_with_best", "bias_screened_out")
add("champions", lambda w: w.champions.select(*[joined(c) if c in LISTS else c for c in CHAMPION]), f"SELECT {', '.join(CHAMPION)} FROM champions", "champion_mae numerical_leader_mae")
add("two_scope_selection", lambda w: selection.two_scope_selection(w.combined, w.engine).select(
        "series_id", "metric", "horizon", "champion", "champion_mae", "champion_full_dev", "champion_full_dev_mae", "full_dev_numerical_leader", "full_dev_n",
        "rankings_agree", "governing_scope_note", "n_scored", "selection_scope", "window_rule",
        F.array_join(F.transform("full_dev_ranking", lambda x: x["model"]), ",").alias("full_dev_order")), """
    SELECT f.series_id, f.metric, f.horizon, g.champion, g.champion_mae, f.champion AS champion_full_dev, f.champion_mae AS champion_full_dev_mae,
        f.numerical_leader AS full_dev_numerical_leader, f.n_scored AS full_dev_n, f.champion IS NOT DISTINCT FROM g.champion AS rankings_agree,
        CASE WHEN f.champion IS NOT DISTINCT FROM g.champion THEN 'scopes_agree' ELSE 'scopes_differ' END AS governing_scope_note,
        coalesce(g.n_scored, 0) AS n_scored, 'post_cutoff_common_support' AS selection_scope, 'capped' AS window_rule, o.full_dev_order
    FROM f_champions f LEFT JOIN champions g ON f.series_id = g.series_id AND f.metric = g.metric AND f.horizon = g.horizon
    JOIN (SELECT series_id, metric, horizon, string_agg(model, ',' ORDER BY MAE, model) AS full_dev_order FROM f_maes GROUP BY 1, 2, 3) o
        ON o.series_id = f.series_id AND o.metric = f.metric AND o.horizon = f.horizon""", "champion_mae champion_full_dev_mae")
add("champion_lookup", lambda w: selection.champion_for(w.champions, "load", 7).select("series_id", "champion"),
    "SELECT series_id, champion FROM champions WHERE metric = 'load' AND horizon = 7")

# ================================================================= intervals
add("residual_pool_quantiles", lambda w: w.quantiles, "SELECT * FROM quant", "q_low q_high")
FORWARD = ["series_id", "metric", "horizon", "model", "is_champion", "champion", "origin_pos", "origin_date", "forecast_pos", "point_forecast", "lower",
           "lower_unclipped", "clipped_at_floor", "upper", "interval_width", "n_residuals", "interval_sufficient", "interval_note", "nominal_coverage",
           "train_start_pos", "train_n_positions"]
FORWARD_SQL = ", ".join({"n_residuals": "nres AS n_residuals", "interval_sufficient": "enough AS interval_sufficient",
                         "nominal_coverage": "CAST(0.95 AS DOUBLE) AS nominal_coverage"}.get(c, c) for c in FORWARD)
add("forward_forecasts", lambda w: w.forward.select(*FORWARD), f"SELECT {FORWARD_SQL} FROM forward",
    "point_forecast lower lower_unclipped upper interval_width nominal_coverage")
COVER = ["n", "n_covered", "empirical_coverage", "nominal_coverage", "band_low", "band_high", "covers_nominal", "note"]
COVER_DOUBLES = "empirical_coverage nominal_coverage band_low band_high"
add("leave_one_out_coverage", lambda w: intervals.banded(intervals.leave_one_out_counts(w.pool, w.engine), w.engine).select(
        "series_id", "metric", "horizon", "model", *COVER),
    f"SELECT series_id, metric, horizon, model, {', '.join(COVER)} FROM ({O.band('SELECT * FROM loo')})", COVER_DOUBLES)
add("champion_coverage", lambda w: w.coverage.select("series_id", "metric", "horizon", "model", *COVER, "evidence"),
    f"SELECT series_id, metric, horizon, model, {', '.join(COVER)}, 'primary_pooled_folds_leave_one_out' AS evidence FROM coverage", COVER_DOUBLES)
add("holdout_evaluation", lambda w: w.holdout, "SELECT * FROM holdout", "y_true point_forecast lower upper abs_error")
add("holdout_coverage_band", lambda w: intervals.coverage(w.holdout, ["series_id", "metric"], w.engine).select("series_id", "metric", *COVER),
    f"""SELECT series_id, metric, {', '.join(COVER)} FROM ({O.band('''SELECT series_id, metric,
        count(CASE WHEN y_true IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL THEN 1 END) AS n,
        count(CASE WHEN y_true BETWEEN lower AND upper THEN 1 END) AS n_covered FROM holdout GROUP BY 1, 2''')})""", COVER_DOUBLES)
add("holdout_summary", lambda w: intervals.holdout_summary(w.holdout), """
    SELECT series_id, metric, horizon, count(*) AS n, count(CASE WHEN covered THEN 1 END) AS n_covered, avg(abs_error) AS mae,
        count(CASE WHEN covered THEN 1 END) / count(*) AS coverage FROM holdout GROUP BY 1, 2, 3""", "mae coverage")
add("calibration_notes", lambda w: intervals.calibration_notes(w.forward, w.coverage), """
    SELECT f.series_id, f.metric, f.horizon, f.model, CASE WHEN c.covers_nominal IS NULL THEN 'no_evidence' WHEN c.covers_nominal THEN 'calibrated' ELSE 'not_calibrated' END AS status,
        c.empirical_coverage FROM forward f LEFT JOIN coverage c ON c.series_id = f.series_id AND c.metric = f.metric AND c.horizon = f.horizon AND c.model = f.model""", "empirical_coverage")
add("calibration_failures", lambda w: intervals.calibration_failures(w.coverage), """
    SELECT metric, count(*) AS n_cells, count(CASE WHEN NOT covers_nominal THEN 1 END) AS n_failed, avg(CASE WHEN covers_nominal THEN 0 ELSE 1.0::DOUBLE END) AS share_failed
    FROM coverage GROUP BY 1""", "share_failed")

# ================================================================= imbalance
add("component_residuals", lambda w: w.component, "SELECT * FROM component", "y_true y_pred residual abs_residual")
COMPONENT_ALL = "(SELECT * FROM resid WHERE metric = 'intake' AND model IN ('seasonal_naive', 'moving_average'))"
add("residual_correlation", lambda w: imbalance.residual_correlation(
        imbalance.component_residuals(w.predictions, w.engine, recent_only=False), w.outflow_residuals, w.engine), f"""
    SELECT *, coalesce(abs(correlation) < 0.2, false) AS independence_admissible FROM (
        SELECT series_id, component_model, target_model, {O.MOMENTS} FROM ({O.paired(COMPONENT_ALL, "(SELECT * FROM resid WHERE metric = 'release')")})
        GROUP BY 1, 2, 3) WHERE n_paired >= 3""", "correlation covariance var_component var_target")
add("component_stats", lambda w: imbalance.component_stats(w.component, w.outflow_residuals.filter(
        F.col("origin_post_cutoff") & (F.col("window_rule") == "capped"))), "SELECT * FROM component_stats", "var_component var_target correlation covariance")
IMBALANCE = ["series_id", "horizon", "origin_date", "component_model", "component_forecast", "target_model", "target_forecast", "net_pressure", "variance", "std",
             "lower_1sd", "upper_1sd", "uncertainty_form", "measured_correlation", "n_paired_residuals", "var_component", "var_target", "interpretation"]
add("imbalance_forecast", lambda w: w.imbalance.select(*IMBALANCE), f"SELECT {', '.join(IMBALANCE)} FROM imbalance",
    "component_forecast target_forecast net_pressure variance std lower_1sd upper_1sd measured_correlation var_component var_target")
add("imbalance_summary", lambda w: imbalance.imbalance_summary(w.imbalance), """
    SELECT series_id, arg_max(horizon, (round(abs(net_pressure), 9), -horizon)) AS worst_horizon, arg_max(net_pressure, (round(abs(net_pressure), 9), -horizon)) AS worst_net_pressure,
        min(std) AS min_std, max(std) AS max_std FROM imbalance WHERE net_pressure IS NOT NULL GROUP BY 1""", "worst_net_pressure min_std max_std")
add("net_flow_tail", lambda w: imbalance.tail(imbalance.net_flow(w.master, w.engine), 120), """
    SELECT series_id, ds, pos, net_flow FROM (SELECT series_id, ds, pos, intake - release AS net_flow, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS rn FROM master)
    WHERE rn <= 120""")

# ================================================================= early warning
add("trailing_threshold", lambda w: warning.thresholds(w.targets, w.engine), "SELECT * FROM thresholds", "threshold")


def _watch(w: Workspace) -> DataFrame:
    origins = w.folds.select("series_id", F.col("origin_pos").alias("pos")).distinct()
    return warning.watch(w.targets, w.engine, w.engine.warn_grid).join(origins, ["series_id", "pos"]).select(
        "series_id", "metric", F.col("pos").alias("origin_pos"), "percentile", "threshold", "crossing_offset")


add("first_crossing", _watch, "SELECT * FROM watch", "percentile threshold")
BACKTEST = ["series_id", "metric", "fold_id", "origin_pos", "origin_date", "percentile", "threshold", "fired", "highest_tier", "earliest_tier", "fired_horizons",
            "outcome", "lead_time", "forecast_h1", "forecast_h7", "forecast_h14"]
BACK_DOUBLES = "percentile threshold forecast_h1 forecast_h7 forecast_h14"
add("early_warning_backtest", lambda w: w.backtest.select(*BACKTEST), f"SELECT {', '.join(BACKTEST)} FROM backtest", BACK_DOUBLES)
add("tier_classification", lambda w: warning.classify(
        w.forward.filter("is_champion").select("series_id", "metric", "origin_pos", "horizon", F.col("point_forecast").alias("forecast")).join(
            warning.thresholds(w.targets, w.engine).withColumnRenamed("pos", "origin_pos"), ["series_id", "metric", "origin_pos"]),
        ["series_id", "metric"], w.engine).select("series_id", "metric", "threshold", "fired", "highest_tier", "earliest_tier", "fired_horizons", "confidence_note"), f"""
    SELECT series_id, metric, threshold, short IS NOT NULL AS fired, {O.TIER.format(h="short")} AS highest_tier, {O.TIER.format(h="long")} AS earliest_tier, fired_horizons,
        CASE WHEN threshold IS NULL THEN 'threshold_missing' WHEN short IS NULL THEN 'no_tier' WHEN short = 14 THEN 'longest_horizon_only'
             ELSE {O.TIER.format(h="short")} || ':' || short END AS confidence_note
    FROM (SELECT f.series_id, f.metric, any_value(t.threshold) AS threshold, min(CASE WHEN point_forecast > t.threshold THEN horizon END) AS short,
            max(CASE WHEN point_forecast > t.threshold THEN horizon END) AS long,
            coalesce(string_agg(CASE WHEN point_forecast > t.threshold THEN CAST(horizon AS VARCHAR) END, ',' ORDER BY horizon), '') AS fired_horizons
          FROM forward f JOIN thresholds t ON t.series_id = f.series_id AND t.metric = f.metric AND t.pos = f.origin_pos WHERE f.is_champion GROUP BY 1, 2)""", "threshold")
add("capacity_tiers", lambda w: warning.capacity(
        w.forward.select("series_id", "metric", "horizon", "model", F.col("point_forecast").alias("forecast"), F.col("origin_pos").alias("pos")).join(
            warning.thresholds(w.targets, w.engine), ["series_id", "metric", "pos"]).drop("pos"), w.engine), """
    SELECT f.series_id, f.metric, f.horizon, f.model, f.point_forecast AS forecast, t.threshold,
        CASE WHEN f.point_forecast IS NULL OR t.threshold IS NULL OR t.threshold <= 0 THEN 'Normal' WHEN f.point_forecast > t.threshold THEN 'High'
             WHEN f.point_forecast >= t.threshold * CAST(0.9 AS DOUBLE) THEN 'Elevated' ELSE 'Normal' END AS capacity_tier
    FROM forward f JOIN thresholds t ON t.series_id = f.series_id AND t.metric = f.metric AND t.pos = f.origin_pos""", "forecast threshold")
SUMMARY = ["n_origins", "true_positive", "false_positive", "false_negative", "true_negative", "median_surge_lead_time", "min_surge_lead_time", "max_surge_lead_time",
           "n_fired", "false_positive_rate", "false_negative_rate", "precision"]
SUM_DOUBLES = "median_surge_lead_time false_positive_rate false_negative_rate precision"
add("early_warning_summary", lambda w: warning.summarise(w.backtest, ["series_id", "metric"]).select("series_id", "metric", *SUMMARY),
    f"SELECT series_id, metric, {', '.join(SUMMARY)} FROM warning_summary", SUM_DOUBLES)
add("early_warning_sensitivity", lambda w: warning.sensitivity(w.backtest_grid, w.engine).select(
        "series_id", "metric", "percentile", "is_frozen_operating_point", *SUMMARY), f"""
    SELECT series_id, metric, percentile, percentile = CAST(0.9 AS DOUBLE) AS is_frozen_operating_point, {', '.join(SUMMARY)}
    FROM ({O.summary("grid", "series_id, metric, percentile")})""", "percentile " + SUM_DOUBLES)
add("fired_origins", lambda w: warning.fired_origins(w.backtest), """
    SELECT series_id, metric, origin_date, threshold, highest_tier, earliest_tier, fired_horizons, outcome, lead_time FROM backtest WHERE highest_tier IS NOT NULL""", "threshold")

# ================================================================= indicators and lookups
KPI = ["series_id", "metric", "forecast_accuracy_pct", "capacity_tier", "threshold_proxy_value", "threshold_is_proxy", "median_surge_lead_time_periods",
       "false_positive_rate", "false_negative_rate", "n_backtest_origins", "n_fired", "forecast_stability_index"]
add("kpi_summary", lambda w: w.kpis.select(*KPI), """
    SELECT t.series_id, t.metric, 100 - m.sMAPE AS forecast_accuracy_pct,
        CASE WHEN f.point_forecast IS NULL OR t.threshold IS NULL OR t.threshold <= 0 THEN 'Normal' WHEN f.point_forecast > t.threshold THEN 'High'
             WHEN f.point_forecast >= t.threshold * CAST(0.9 AS DOUBLE) THEN 'Elevated' ELSE 'Normal' END AS capacity_tier,
        t.threshold AS threshold_proxy_value, true AS threshold_is_proxy, s.median_surge_lead_time AS median_surge_lead_time_periods, s.false_positive_rate, s.false_negative_rate,
        s.n_origins AS n_backtest_origins, s.n_fired, h.q90 / nullif(h.q50, 0) AS forecast_stability_index
    FROM thresholds t JOIN bounds b ON b.series_id = t.series_id AND b.last_real_pos = t.pos
    LEFT JOIN champions c ON c.series_id = t.series_id AND c.metric = t.metric AND c.horizon = 1
    LEFT JOIN cmetrics m ON m.series_id = t.series_id AND m.metric = t.metric AND m.horizon = 1 AND m.model = c.champion AND m.window_rule = 'capped'
        AND m.fold_scope = 'post_cutoff_common_support'
    LEFT JOIN forward f ON f.series_id = t.series_id AND f.metric = t.metric AND f.horizon = 1 AND f.is_champion
    LEFT JOIN warning_summary s ON s.series_id = t.series_id AND s.metric = t.metric
    LEFT JOIN (SELECT series_id, metric, quantile_cont(abs_error, 0.5) AS q50, quantile_cont(abs_error, 0.9) AS q90 FROM holdout GROUP BY 1, 2) h
        ON h.series_id = t.series_id AND h.metric = t.metric""",
    "forecast_accuracy_pct threshold_proxy_value median_surge_lead_time_periods false_positive_rate false_negative_rate forecast_stability_index")
add("forecast_row", lambda w: kpi.forecast_row(w.forward, "load", "naive", 7).select("series_id", "point_forecast", "lower", "upper"),
    "SELECT series_id, point_forecast, lower, upper FROM forward WHERE metric = 'load' AND model = 'naive' AND horizon = 7", "point_forecast lower upper")
add("available_models", lambda w: kpi.available_models(w.forward),
    "SELECT series_id, metric, horizon, model, CAST(row_number() OVER (PARTITION BY series_id, metric, horizon ORDER BY is_champion DESC, model) AS INTEGER) AS place FROM forward")
CHOSEN = ("naive", "moving_average", "ensemble")
O.block("scen", "SELECT * FROM forward WHERE model IN ('naive', 'moving_average', 'ensemble') AND point_forecast IS NOT NULL")
LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kpi.model_labels(E_).items())
HLABEL = "CAST({h} AS VARCHAR) || ' period' || CASE WHEN {h} = 1 THEN '' ELSE 's' END || ' (' || CASE {h} WHEN 1 THEN '~1 day' WHEN 7 THEN '~7 days' WHEN 14 THEN '~14 days' ELSE '~' END || ')'"
add("scenario_table", lambda w: kpi.scenarios(w.forward, CHOSEN, w.engine), f"""
    SELECT series_id, metric, horizon, model, CASE model {LABEL} ELSE model END AS model_label, {HLABEL.format(h="horizon")} AS horizon_label,
        point_forecast, lower, upper, interval_width, is_champion FROM scen""", "point_forecast lower upper interval_width")
SPREAD = """SELECT series_id, metric, horizon, min(point_forecast) AS lowest, max(point_forecast) AS highest, avg(point_forecast) AS mean,
    max(point_forecast) - min(point_forecast) AS model_spread FROM scen GROUP BY 1, 2, 3"""
add("scenario_spread", lambda w: kpi.scenario_spread(kpi.scenarios(w.forward, CHOSEN, w.engine)), SPREAD, "lowest highest mean model_spread")
add("scenario_verdict", lambda w: kpi.scenario_verdict(kpi.scenarios(w.forward, CHOSEN, w.engine)), f"""
    SELECT s.series_id, s.metric, x.model AS widest_model, x.horizon AS widest_horizon, x.interval_width AS widest_interval, s.max_spread,
        coalesce(x.interval_width > s.max_spread, false) AS interval_exceeds_spread
    FROM (SELECT series_id, metric, max(model_spread) AS max_spread FROM ({SPREAD}) GROUP BY 1, 2) s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY interval_width DESC, horizon, model DESC) AS rn FROM scen WHERE interval_width IS NOT NULL) x
        ON x.series_id = s.series_id AND x.metric = s.metric AND x.rn = 1""", "widest_interval max_spread")
add("latest_against_forecast", lambda w: kpi.latest_against_forecast(w.targets, w.forward), """
    SELECT p.series_id, p.metric, arg_max(p.value, p.pos) AS latest_value, max(p.pos) AS latest_pos, f.model AS champion, f.point_forecast
    FROM panel p JOIN forward f ON f.series_id = p.series_id AND f.metric = p.metric AND f.is_champion AND f.horizon = 1
    WHERE p.value IS NOT NULL GROUP BY p.series_id, p.metric, f.model, f.point_forecast""", "latest_value point_forecast")
add("display_labels", lambda w: kpi.labels(w.forward, w.engine),
    f"SELECT DISTINCT model, horizon, CASE model {LABEL} ELSE model END AS model_label, {HLABEL.format(h='horizon')} AS horizon_label FROM forward")

# ================================================================= exploration
O.block("present", """
    SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id, metric) AS n
    FROM panel WHERE value IS NOT NULL""")
O.block("stepped", """
    SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id, metric) AS n
    FROM (SELECT series_id, metric, pos, ds, is_imputed, value - lag(value) OVER (PARTITION BY series_id, metric ORDER BY pos) AS value
          FROM panel WHERE value IS NOT NULL) WHERE value IS NOT NULL""")
add("break_scan", lambda w: explore.breaks(w.targets), """
    WITH c AS (SELECT series_id, metric, ds, i, n // 2 AS half, round(sum(dev) OVER (PARTITION BY series_id, metric ORDER BY i ROWS UNBOUNDED PRECEDING), 3) AS cusum
        FROM (SELECT *, value - avg(value) OVER (PARTITION BY series_id, metric) AS dev FROM present WHERE metric <> 'intake')),
    d AS (SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY abs(cusum) DESC, i) AS rn FROM c),
    top AS (SELECT * FROM d WHERE rn = 1),
    other AS (SELECT c.*, row_number() OVER (PARTITION BY c.series_id, c.metric ORDER BY abs(c.cusum) DESC, c.i) AS rn
        FROM c JOIN top t ON t.series_id = c.series_id AND t.metric = c.metric AND (c.i >= c.half) <> (t.i >= t.half))
    SELECT t.series_id, t.metric, t.ds AS dominant_ds, t.cusum AS dominant_cusum, o.ds AS secondary_ds, o.cusum AS secondary_cusum
    FROM top t LEFT JOIN other o ON o.series_id = t.series_id AND o.metric = t.metric AND o.rn = 1""", "dominant_cusum secondary_cusum")


def _kruskal(rows: str) -> str:
    return f"""
        WITH r AS (SELECT series_id, metric, isodow(ds) AS g, value, rank() OVER (PARTITION BY series_id, metric ORDER BY value)
                + (count(*) OVER (PARTITION BY series_id, metric, value) - 1) / 2.0::DOUBLE AS rk FROM ({rows})),
        s AS (SELECT series_id, metric, g, sum(rk) * sum(rk) / count(*) AS part, count(*) AS m FROM r GROUP BY 1, 2, 3),
        t AS (SELECT series_id, metric, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT series_id, metric, value, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT s.series_id, s.metric, CAST(sum(m) AS BIGINT) AS n, count(*) AS n_groups,
            (12.0::DOUBLE / (sum(m) * (sum(m) + 1.0::DOUBLE)) * sum(part) - 3 * (sum(m) + 1)) / nullif(1 - any_value(ties) / (CAST(sum(m) AS DOUBLE) * sum(m) * sum(m) - sum(m)), 0) AS h_statistic
        FROM s JOIN t ON t.series_id = s.series_id AND t.metric = s.metric GROUP BY 1, 2"""


OBSERVED = "SELECT * FROM panel WHERE NOT is_imputed AND value IS NOT NULL"
STEPS = "SELECT * FROM (SELECT series_id, metric, ds, value - lag(value) OVER (PARTITION BY series_id, metric ORDER BY pos) AS value FROM panel WHERE NOT is_imputed AND value IS NOT NULL) WHERE value IS NOT NULL"
add("weekday_kruskal_levels", lambda w: explore.kruskal_wallis(w.panel), _kruskal(OBSERVED), "h_statistic")
add("weekday_kruskal_differences", lambda w: explore.kruskal_wallis(w.panel, True), _kruskal(STEPS), "h_statistic")
add("weekday_seasonality_p_values", lambda w: explore.seasonality_test(w.panel), f"""
    SELECT *, p_value < 0.05 AS has_within_week_seasonality FROM (
        SELECT *, CASE WHEN h_statistic > 0 THEN exp(-h_statistic / 2) * list_sum(list_transform(range(0, (n_groups - 1) // 2),
            lambda i: pow(h_statistic / 2, i) / gamma(i + 1))) ELSE 1 END AS p_value FROM ({_kruskal(OBSERVED)}))""", "h_statistic p_value")
add("weekday_groups", lambda w: explore.weekday_groups(w.panel), """
    SELECT series_id, metric, CAST(isodow(ds) - 1 AS INTEGER) AS weekday, strftime(ds, '%a') AS label, count(*) AS count, avg(value) AS mean,
        quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std FROM panel WHERE NOT is_imputed AND value IS NOT NULL GROUP BY 1, 2, 3, 4""", "mean median std")


def _acf(rows: str) -> str:
    return f"""
        WITH d AS (SELECT series_id, metric, i, value - avg(value) OVER (PARTITION BY series_id, metric) AS d FROM {rows}),
        v AS (SELECT series_id, metric, sum(d * d) AS v FROM d GROUP BY 1, 2)
        SELECT a.series_id, a.metric, CAST(a.i - b.i AS INTEGER) AS lag, sum(a.d * b.d) / nullif(any_value(v.v), 0) AS acf
        FROM d a JOIN d b ON b.series_id = a.series_id AND b.metric = a.metric AND b.i BETWEEN a.i - 40 AND a.i
        JOIN v ON v.series_id = a.series_id AND v.metric = a.metric GROUP BY 1, 2, 3"""


add("autocorrelation_levels", lambda w: explore.autocorrelation(explore.present(w.targets)), _acf("(SELECT * FROM present WHERE metric <> 'intake')"), "acf")
add("autocorrelation_differences", lambda w: explore.autocorrelation(explore.differenced(w.targets)), _acf("(SELECT * FROM stepped WHERE metric <> 'intake')"), "acf")
add("partial_autocorrelation", lambda w: explore.partial_autocorrelation(explore.autocorrelation(explore.present(w.targets))), f"""
    WITH RECURSIVE l AS (SELECT series_id, metric, list(acf ORDER BY lag) AS r FROM ({_acf("(SELECT * FROM present WHERE metric <> 'intake')")}) GROUP BY 1, 2),
    z AS (
        SELECT series_id, metric, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS pacf FROM l
        UNION ALL
        SELECT series_id, metric, r, k + 1, list_append(list_transform(phi, lambda x, i: x - last * phi[len(phi) - i + 1]), last), last
        FROM (SELECT *, CASE WHEN k = 0 THEN r[2] ELSE
                (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) END AS last
              FROM z WHERE k < len(r) - 1))
    SELECT series_id, metric, k AS lag, pacf FROM z""", "pacf")
DECOMPOSED = """
    SELECT *, value - trend - seasonal AS resid FROM (
        SELECT t.*, p.pm - c.centre AS seasonal FROM trended t
        JOIN phases p ON p.series_id = t.series_id AND p.metric = t.metric AND p.phase = t.i % 7
        JOIN (SELECT series_id, metric, avg(pm) AS centre FROM phases GROUP BY 1, 2) c ON c.series_id = t.series_id AND c.metric = t.metric)"""
O.block("trended", """
    SELECT a.series_id, a.metric, a.pos, a.i, a.value, CASE WHEN count(b.value) = 7 THEN avg(b.value) END AS trend
    FROM present a LEFT JOIN present b ON b.series_id = a.series_id AND b.metric = a.metric AND b.i BETWEEN a.i - 3 AND a.i + 3
    WHERE a.metric <> 'intake' GROUP BY 1, 2, 3, 4, 5""")
O.block("phases", "SELECT series_id, metric, i % 7 AS phase, avg(value - trend) AS pm FROM trended GROUP BY 1, 2, 3")
O.block("decomposed", DECOMPOSED)
add("seasonal_decomposition", lambda w: explore.decomposition(w.targets, w.engine.season).select("series_id", "metric", "pos", "trend", "seasonal", "resid"),
    "SELECT series_id, metric, pos, trend, seasonal, resid FROM decomposed", "trend seasonal resid")
add("decomposition_strengths", lambda w: explore.strengths(explore.decomposition(w.targets, w.engine.season)), """
    SELECT series_id, metric, CASE WHEN var_pop(seasonal + resid) > 0 THEN greatest(0, 1 - var_pop(resid) / var_pop(seasonal + resid)) ELSE 0 END AS seasonal_strength,
        CASE WHEN var_pop(trend + resid) > 0 THEN greatest(0, 1 - var_pop(resid) / var_pop(trend + resid)) ELSE 0 END AS trend_strength
    FROM decomposed WHERE resid IS NOT NULL GROUP BY 1, 2""", "seasonal_strength trend_strength")


def _kpss(rows: str) -> str:
    return f"""
        WITH e AS (SELECT series_id, metric, i, n, value - a - b * (i + 1) AS e FROM (
            SELECT *, regr_slope(value, i + 1) OVER s AS b, regr_intercept(value, i + 1) OVER s AS a FROM {rows} WINDOW s AS (PARTITION BY series_id, metric))),
        w AS (SELECT *, sum(e) OVER (PARTITION BY series_id, metric ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM e),
        base AS (SELECT series_id, metric, max(n) AS n, sum(s * s) AS ss, sum(e * e) / max(n) AS g0 FROM w GROUP BY 1, 2),
        g AS (SELECT a.series_id, a.metric, a.i - b.i AS k, sum(a.e * b.e) AS p FROM e a JOIN e b ON b.series_id = a.series_id AND b.metric = a.metric
              AND b.i < a.i GROUP BY 1, 2, 3),
        auto AS (SELECT b.series_id, b.metric, least(CAST(floor(1.1447::DOUBLE * pow(pow(sum(g.k * g.p / (b.n / 2.0::DOUBLE)) / (any_value(b.g0) + sum(g.p / (b.n / 2.0::DOUBLE))), 2), 1.0::DOUBLE / 3)
                    * pow(any_value(b.n), 1.0::DOUBLE / 3)) AS INTEGER), any_value(b.n) - 1) AS lags
                 FROM base b JOIN g ON g.series_id = b.series_id AND g.metric = b.metric AND g.k <= floor(pow(b.n, 2.0::DOUBLE / 9)) GROUP BY 1, 2)
        SELECT b.series_id, b.metric, b.n, CAST(a.lags AS INTEGER) AS lags, b.ss / (CAST(b.n AS DOUBLE) * b.n) / (b.g0 + 2 * coalesce(x.weighted, 0) / b.n) AS kpss_statistic,
            CASE WHEN b.ss / (CAST(b.n AS DOUBLE) * b.n) / (b.g0 + 2 * coalesce(x.weighted, 0) / b.n) < 0.146 THEN 'stationary' ELSE 'non-stationary' END AS kpss_conclusion
        FROM base b JOIN auto a ON a.series_id = b.series_id AND a.metric = b.metric
        LEFT JOIN (SELECT a.series_id, a.metric, sum((1 - g.k / (a.lags + 1.0::DOUBLE)) * g.p) AS weighted FROM auto a JOIN g ON g.series_id = a.series_id AND g.metric = a.metric
                   AND g.k <= a.lags GROUP BY 1, 2) x ON x.series_id = b.series_id AND x.metric = b.metric"""


add("kpss_levels", lambda w: explore.kpss(explore.present(w.targets)), _kpss("(SELECT * FROM present WHERE metric <> 'intake')"), "kpss_statistic")
add("kpss_differences", lambda w: explore.kpss(explore.differenced(w.targets)), _kpss("(SELECT * FROM stepped WHERE metric <> 'intake')"), "kpss_statistic")
add("adf_levels", lambda w: explore.adf(explore.present(w.targets)))
add("joint_stationarity", lambda w: explore.joint_stationarity(explore.present(w.targets)))


def _corr(form: str) -> str:
    shaped = {
        "levels": "CAST({c} AS DOUBLE)", "differences": "CAST({c} - lag({c}) OVER w AS DOUBLE)", "detrended": "{c} - avg({c}) OVER f",
    }[form]
    names = ("intake", "release", "load")
    cols = ", ".join(f"{shaped.format(c=c)} AS {c}" for c in names)
    rows = f"""(SELECT series_id, {cols} FROM master WHERE NOT is_imputed WINDOW w AS (PARTITION BY series_id ORDER BY pos),
        f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
    return " UNION ALL ".join(
        f"SELECT series_id, '{a}' AS measure_a, '{b}' AS measure_b, nullif(corr({a}, {b}), 'nan'::DOUBLE) AS correlation FROM {rows} GROUP BY series_id" for a in names for b in names)


for _form in ("levels", "differences", "detrended"):
    add(f"correlations_{_form}", lambda w, f=_form: explore.correlations(w.master, w.engine, f), _corr(_form), "correlation")


# ================================================================= the whole candidate run
# All seven candidates on the engine as it stands, from common support to the indicators.  No engine that reads only the raw
# tables can grow the trees, so these are held against the checking SQL over their own predictions (tests/test_full_chain.py).
def whole(name: str, plan: Callable[[Workspace], DataFrame]) -> None:
    add(f"full_{name}", plan, engine=FULL, models=ALL_MODELS)


whole("candidate_run", lambda w: w.predictions.select(*FACT))
whole("metrics", lambda w: w.combined_metrics)
whole("fit_reliability", lambda w: scoring.fit_reliability(w.predictions))
whole("baseline_gate", lambda w: scoring.gate(
    w.metrics.filter("fold_scope = 'post_cutoff_common_support'"), tuple(m for m in ALL_MODELS if m not in BASELINES)))
whole("ensemble_components", lambda w: w.pairs)
whole("ensemble_forecasts", lambda w: w.ensemble.select(
    "series_id", "metric", "model", "window_rule", "fold_id", "horizon", "y_true", "y_pred", "ensemble_components"))
whole("champions", lambda w: w.champions.select(*[joined(c) if c in LISTS else c for c in CHAMPION]))
whole("champion_coverage", lambda w: w.coverage.select("series_id", "metric", "horizon", "model", *COVER, "evidence"))
whole("forward_forecasts", lambda w: w.forward.select(*FORWARD))
whole("holdout_evaluation", lambda w: w.holdout)
whole("early_warning_backtest", lambda w: w.backtest.select(*BACKTEST))
whole("kpi_summary", lambda w: w.kpis.select(*KPI))
