"""Named SQL building blocks of the checking queries.

Each block is one common table expression; :func:`sql` collects exactly the blocks
a statement needs.  They restate the definitions in plain SQL (range joins,
self-joins, unnested draws) rather than the way the Spark plans compute them.
"""

from __future__ import annotations

import re

from tidemark.config import Engine

M31 = 2147483647
LEVELS = "(VALUES (0.75::DOUBLE),(0.80::DOUBLE),(0.85::DOUBLE),(0.90::DOUBLE),(0.95::DOUBLE))"
ORDER = (
    "['naive','seasonal_naive','moving_average','sarima','exponential_smoothing',"
    "'random_forest','gradient_boosting','ensemble']"
)

BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


# ------------------------------------------------------------------ observations
ALL_DAYS = (0, 1, 2, 3, 4, 5, 6)


def observation_blocks(
    prefix: str, key: str, source: str, weekdays: tuple = ALL_DAYS, days: tuple = (), season: int = 7,
) -> None:
    """daily -> obs -> master for one series key, names carrying ``prefix``."""
    p = prefix
    block(f"{p}arrivals", f"""
        SELECT {key} AS series_id, CAST(o_orderdate AS DATE) AS ds, count(*) AS intake,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM {source} GROUP BY 1, 2""")
    block(f"{p}departures", f"""
        SELECT {key} AS series_id, s.first_ship AS ds, count(*) AS release
        FROM {source} JOIN ship s ON s.l_orderkey = o_orderkey GROUP BY 1, 2""")
    block(f"{p}daily", f"""
        SELECT coalesce(a.series_id, d.series_id) AS series_id, coalesce(a.ds, d.ds) AS ds, coalesce(a.intake, 0) AS intake, coalesce(d.release, 0) AS release,
               CAST(round_even(CAST(cents AS DOUBLE) / (CAST(100 AS DOUBLE) * intake), 0) AS BIGINT) AS load
        FROM {p}arrivals a FULL JOIN {p}departures d ON d.series_id = a.series_id AND d.ds = a.ds""")
    named = f"OR ds IN ({', '.join(f"DATE '{d}'" for d in days)})" if days else ""
    block(f"{p}obs", f"SELECT * FROM {p}daily WHERE isodow(ds) - 1 IN {weekdays} {named}")
    block(f"{p}span", f"SELECT series_id, min(ds) AS a, max(ds) AS b FROM {p}obs GROUP BY 1")
    block(f"{p}template", f"""
        SELECT series_id, ds FROM (
            SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM {p}span)
        WHERE isodow(ds) - 1 IN {weekdays}""")
    block(f"{p}spine", f"SELECT series_id, ds FROM {p}template UNION SELECT series_id, ds FROM {p}obs")
    block(f"{p}aligned", f"""
        SELECT s.series_id, s.ds,
               CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.ds) - 1 AS INTEGER) AS pos,
               o.ds IS NULL AS is_imputed, o.intake, o.release, o.load
        FROM {p}spine s LEFT JOIN {p}obs o ON o.series_id = s.series_id AND o.ds = s.ds""")
    block(f"{p}known", f"""
        SELECT *,
            last_value(CASE WHEN load IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
            last_value(load IGNORE NULLS) OVER b AS v0,
            first_value(CASE WHEN load IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1,
            first_value(load IGNORE NULLS) OVER a AS v1
        FROM {p}aligned
        WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
    block(f"{p}master", f"""
        SELECT series_id, ds, pos, is_imputed, intake, release,
            coalesce(load, CASE WHEN v1 IS NULL THEN v0 ELSE CAST(round_even(
                (v1 - v0) / CAST(nullif(p1 - p0, 0) AS DOUBLE) * (pos - p0) + v0, 0) AS BIGINT) END) AS load,
            load IS NULL AS is_imputed_load
        FROM {p}known""")
    backtest_blocks(p, season)


def backtest_blocks(p: str, m: int) -> None:
    """master -> panel -> bounds -> folds -> training state -> requests -> baselines."""
    block(f"{p}panel", f"""
        SELECT series_id, 'intake' AS metric, 'flow' AS kind, ds, pos, CAST(intake AS DOUBLE) AS value, is_imputed FROM {p}master
        UNION ALL SELECT series_id, 'release', 'flow', ds, pos, CAST(release AS DOUBLE), is_imputed FROM {p}master
        UNION ALL SELECT series_id, 'load', 'stock', ds, pos, CAST(load AS DOUBLE), is_imputed_load FROM {p}master""")
    block(f"{p}ranked", f"""
        SELECT *, CAST(min(ds) OVER s AS DATE) + CAST(floor(date_diff('day', CAST(min(ds) OVER s AS DATE), CAST(max(ds) OVER s AS DATE)) * CAST(0.7 AS DOUBLE)) AS INTEGER) AS cap_date,
            count(CASE WHEN NOT is_imputed THEN 1 END) OVER (PARTITION BY series_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS rk
        FROM {p}master WINDOW s AS (PARTITION BY series_id)""")
    block(f"{p}bounds", f"""
        SELECT series_id, count(*) AS n_slots, min(ds) AS first_ds, max(ds) AS last_ds, min(cap_date) AS cap_date,
            min(CASE WHEN ds >= cap_date THEN pos END) AS cutoff_pos,
            max(CASE WHEN NOT is_imputed THEN pos END) AS last_real_pos,
            max(CASE WHEN NOT is_imputed AND rk = 60 THEN pos END) AS holdout_start_pos,
            max(CASE WHEN NOT is_imputed AND rk = 60 THEN pos END) - 1 AS dev_end_pos
        FROM {p}ranked GROUP BY series_id""")
    block(f"{p}flagged", f"""
        SELECT series_id, ds, pos, is_imputed,
            coalesce(lag(is_imputed) OVER w, false) OR coalesce(lead(is_imputed) OVER w, false) AS adjacent,
            max(CASE WHEN NOT is_imputed THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS train_cutoff_pos
        FROM {p}master WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
    block(f"{p}origins", f"""
        SELECT o.series_id, CAST((o.pos - 49) // 10 AS INTEGER) AS fold_id, o.pos AS origin_pos, o.ds AS origin_date,
            o.train_cutoff_pos, b.cutoff_pos, b.holdout_start_pos, b.dev_end_pos, b.n_slots,
            o.is_imputed AS origin_is_imputed, o.adjacent AS origin_adjacent_to_gap,
            h.horizon, t.pos AS test_pos, CAST(t.pos - o.train_cutoff_pos AS INTEGER) AS effective_lead,
            t.ds AS test_date, t.is_imputed AS test_is_imputed, t.adjacent AS test_adjacent_to_gap,
            o.is_imputed OR o.adjacent OR bool_or(h.horizon = 1 AND t.is_imputed) OVER (PARTITION BY o.series_id, o.pos) AS gap_contaminated
        FROM {p}flagged o JOIN {p}bounds b ON b.series_id = o.series_id
        CROSS JOIN (VALUES (1), (7), (14)) h(horizon)
        JOIN {p}flagged t ON t.series_id = o.series_id AND t.pos = o.pos + h.horizon
        WHERE o.pos >= 49 AND (o.pos - 49) % 10 = 0""")
    block(f"{p}folds", f"SELECT * FROM {p}origins WHERE origin_pos + 14 <= dev_end_pos")
    block(f"{p}hfolds", f"SELECT * FROM {p}origins WHERE origin_pos + 14 <= n_slots - 1 AND origin_pos + 1 >= holdout_start_pos")
    block(f"{p}jumps", f"""
        SELECT q.*, b.cutoff_pos, abs(value - lag(value, {m}) OVER (PARTITION BY q.series_id, metric ORDER BY pos)) AS jump
        FROM {p}panel q JOIN {p}bounds b ON b.series_id = q.series_id""")
    block(f"{p}state", f"""
        SELECT series_id, metric, pos AS train_cutoff_pos,
            last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER r AS lp,
            last_value(value IGNORE NULLS) OVER r AS lv,
            count(value) OVER r AS usable_from_start,
            count(CASE WHEN pos >= cutoff_pos THEN value END) OVER r AS usable_from_cap,
            nullif(avg(jump) OVER r, 0) AS mase_scale
        FROM {p}jumps WINDOW r AS (PARTITION BY series_id, metric ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
    block(f"{p}req", f"""
        SELECT *, CAST(train_cutoff_pos - train_start_pos + 1 AS INTEGER) AS train_n_positions,
            CASE WHEN capped THEN usable_from_cap ELSE usable_from_start END AS train_n_usable,
            at_cap AND usable_from_cap < 60 AS fallback_applied,
            capped AND usable_from_cap < 80 AS flips_at_upper_floor
        FROM (SELECT *, CASE WHEN capped THEN cutoff_pos ELSE 0 END AS train_start_pos
              FROM (SELECT *, at_cap AND usable_from_cap >= 60 AS capped
                    FROM (SELECT f.*, s.metric, s.lp, s.lv, s.usable_from_start, s.usable_from_cap, s.mase_scale, r.window_rule,
                                 coalesce(origin_pos >= cutoff_pos, false) AS origin_post_cutoff,
                                 coalesce(r.window_rule = 'capped' AND origin_pos >= cutoff_pos, false) AS at_cap
                          FROM {p}folds f JOIN {p}state s ON s.series_id = f.series_id AND s.train_cutoff_pos = f.train_cutoff_pos
                          CROSS JOIN (VALUES ('full'), ('capped')) r(window_rule))))""")
    forecast_blocks(p, "req", "made", m)


def forecast_blocks(p: str, ask: str, made: str, m: int) -> None:
    """Forecasts of the three baselines and of the level-only smoothing for ``ask``."""
    block(f"{p}{made}_avg", f"""
        SELECT r.series_id, r.metric, r.train_start_pos, r.train_cutoff_pos, sum(q.value) / count(q.value) AS ma
        FROM (SELECT DISTINCT series_id, metric, train_start_pos, train_cutoff_pos FROM {p}{ask}) r
        JOIN {p}panel q ON q.series_id = r.series_id AND q.metric = r.metric
            AND q.pos BETWEEN greatest(r.train_cutoff_pos - 6, r.train_start_pos) AND r.train_cutoff_pos
        WHERE q.value IS NOT NULL GROUP BY 1, 2, 3, 4""")
    block(f"{p}{made}_base", f"""
        SELECT r.*, CASE WHEN lp >= r.train_start_pos THEN lv END AS naive_hat,
            CASE WHEN r.train_cutoff_pos - r.train_start_pos + 1 >= {m} THEN q.value END AS seasonal_hat, a.ma AS ma_hat
        FROM {p}{ask} r
        LEFT JOIN {p}panel q ON q.series_id = r.series_id AND q.metric = r.metric
            AND q.pos = r.train_cutoff_pos + 1 - ({m} - (r.effective_lead - 1) % {m})
        LEFT JOIN {p}{made}_avg a ON a.series_id = r.series_id AND a.metric = r.metric
            AND a.train_start_pos = r.train_start_pos AND a.train_cutoff_pos = r.train_cutoff_pos""")
    block(f"{p}hist", f"SELECT series_id, metric, list(value ORDER BY pos) AS vals FROM {p}panel WHERE metric <> 'intake' GROUP BY 1, 2")
    block(f"{p}{made}_lists", f"""
        SELECT r.series_id, r.metric, r.train_start_pos, r.train_cutoff_pos,
            list_filter(vals[r.train_start_pos + 1 : r.train_cutoff_pos + 1], lambda v: v IS NOT NULL) AS xs
        FROM (SELECT DISTINCT series_id, metric, train_start_pos, train_cutoff_pos FROM {p}{ask}) r
        JOIN {p}hist h ON h.series_id = r.series_id AND h.metric = r.metric""")
    block(f"{p}{made}_ses", f"""
        SELECT series_id, metric, train_start_pos, train_cutoff_pos, len(xs) AS n,
            CASE WHEN len(xs) >= 6 THEN list_reduce(xs, lambda a, x: a + CAST(0.3 AS DOUBLE) * (x - a)) END AS level
        FROM {p}{made}_lists""")
    block(f"{p}{made}", f"""
        SELECT *, 'naive' AS model, naive_hat AS y_pred, false AS fit_failed, '' AS failure_reason FROM {p}{made}_base
        UNION ALL SELECT *, 'seasonal_naive', seasonal_hat, false, '' FROM {p}{made}_base
        UNION ALL SELECT *, 'moving_average', ma_hat, false, '' FROM {p}{made}_base
        UNION ALL SELECT b.*, 'exponential_smoothing', s.level, s.n < 6,
            CASE WHEN s.n < 6 THEN 'insufficient observations (' || s.n || ' finite)' ELSE '' END
        FROM {p}{made}_base b JOIN {p}{made}_ses s ON s.series_id = b.series_id AND s.metric = b.metric
            AND s.train_start_pos = b.train_start_pos AND s.train_cutoff_pos = b.train_cutoff_pos""")


block("ship", "SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship FROM lineitem GROUP BY 1")
observation_blocks("", "o_orderpriority", "orders")
observation_blocks("f_", "o_orderpriority", "orders", (6, 0, 1, 2, 3), ("1995-03-17", "1996-06-14"), 5)
observation_blocks("n_", "CAST(c_nationkey AS VARCHAR)", "orders JOIN customer ON c_custkey = o_custkey")

# the same panel without each series' last day
block("less_daily", "SELECT * FROM daily d WHERE ds < (SELECT max(ds) FROM daily l WHERE l.series_id = d.series_id)")
_UP_TO_MASTER = ("obs", "span", "template", "spine", "aligned", "known", "master")
for _name in _UP_TO_MASTER:
    block(f"less_{_name}", re.sub(rf"\b(FROM|JOIN) (daily|{'|'.join(_UP_TO_MASTER)})\b", r"\1 less_\2", BLOCKS[_name]))

# ------------------------------------------------------------------ hourly panel
block("e_obs", """
    SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, count(*) AS intake, count(DISTINCT user_id) AS release,
        CAST(round_even(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*), 0) AS BIGINT) AS load
    FROM events GROUP BY 1, 2""")
block("e_spine", """
    SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ds
    FROM (SELECT series_id, min(ds) AS a, max(ds) AS b FROM e_obs GROUP BY 1)""")
block("e_aligned", BLOCKS["aligned"].replace("FROM spine s LEFT JOIN obs o", "FROM e_spine s LEFT JOIN e_obs o"))
block("e_known", BLOCKS["known"].replace("FROM aligned", "FROM e_aligned"))
block("e_master", BLOCKS["master"].replace("FROM known", "FROM e_known"))
backtest_blocks("e_", 24)

# ------------------------------------------------------------------ predictions
PRED_COLUMNS = (
    "series_id, metric, model, window_rule, fold_id, origin_pos, origin_date, origin_post_cutoff, horizon, "
    "effective_lead, test_pos, test_date, y_true, y_true_is_observed, y_pred, train_start_pos, train_cutoff_pos, "
    "train_n_positions, train_n_usable, fallback_applied, flips_at_upper_floor, fit_failed, failure_reason, "
    "mase_scale, origin_is_imputed, origin_adjacent_to_gap, test_is_imputed, test_adjacent_to_gap, "
    "gap_contaminated, row_gap_adjacent"
)


def prediction_blocks(p: str, where: str = "true") -> None:
    block(f"{p}raw_pred", f"""
        SELECT d.* , a.value AS y_true, NOT a.is_imputed AND a.value IS NOT NULL AS y_true_is_observed,
            origin_is_imputed OR origin_adjacent_to_gap OR test_is_imputed OR test_adjacent_to_gap AS row_gap_adjacent
        FROM {p}made d JOIN {p}panel a ON a.series_id = d.series_id AND a.metric = d.metric AND a.pos = d.test_pos
        WHERE {where}""")
    block(f"{p}pred", f"""
        SELECT {PRED_COLUMNS},
            bool_and(y_true IS NOT NULL AND y_pred IS NOT NULL AND y_true_is_observed)
                OVER (PARTITION BY series_id, metric, window_rule, fold_id, horizon) AS common_support
        FROM {p}raw_pred""")


prediction_blocks("")
prediction_blocks("n_")
prediction_blocks("e_")


def measures(table: str, keys: str) -> str:
    """The metrics matrix of ``table``; only observed actuals are scored."""
    return f"""
        SELECT {keys},
            count(CASE WHEN s THEN 1 END) AS n_scored, count(CASE WHEN o THEN 1 END) AS n_total,
            count(CASE WHEN o AND y_true IS NULL THEN 1 END) AS n_missing_actual,
            count(CASE WHEN o AND y_true IS NOT NULL AND y_pred IS NULL THEN 1 END) AS n_missing_pred,
            count(CASE WHEN s AND y_true = 0 THEN 1 END) AS n_zero_actual_excluded_from_mape,
            avg(CASE WHEN s THEN abs(y_true - y_pred) END) AS MAE,
            sqrt(avg(CASE WHEN s THEN (y_true - y_pred) * (y_true - y_pred) END)) AS RMSE,
            avg(CASE WHEN s AND y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) * 100 AS MAPE,
            avg(CASE WHEN s THEN CASE WHEN y_true = 0 AND y_pred = 0 THEN 0
                ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END END) * 100 AS sMAPE,
            avg(CASE WHEN s AND mase_scale > 0 THEN abs(y_true - y_pred) / mase_scale END) AS MASE,
            avg(CASE WHEN s THEN y_pred - y_true END) AS ME_bias,
            count(CASE WHEN NOT o AND y_true IS NOT NULL THEN 1 END) AS n_excluded_interpolated_actual,
            count(DISTINCT fold_id) AS n_folds,
            count(DISTINCT CASE WHEN gap_contaminated THEN fold_id END) AS n_gap_contaminated_folds
        FROM (SELECT *, y_true_is_observed AS o,
                     y_true_is_observed AND y_true IS NOT NULL AND y_pred IS NOT NULL AS s FROM {table})
        GROUP BY {keys}"""


CELL = "series_id, metric, model, window_rule, horizon"


def scopes(table: str) -> str:
    return f"""
        SELECT 'all_dev_folds' AS fold_scope, * FROM {table}
        UNION ALL SELECT 'common_support', * FROM {table} WHERE common_support
        UNION ALL SELECT 'post_cutoff_origins', * FROM {table} WHERE origin_post_cutoff
        UNION ALL SELECT 'post_cutoff_common_support', * FROM {table} WHERE origin_post_cutoff AND common_support"""


block("scoped", scopes("pred"))
block("metrics", measures("scoped", f"fold_scope, {CELL}"))


def winners(members: str, name: str) -> str:
    return f"""
        SELECT series_id, metric, horizon, model AS {name} FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id, metric, horizon ORDER BY MAE, model) AS rn
            FROM metrics WHERE fold_scope = 'post_cutoff_common_support' AND window_rule = 'capped'
                AND metric <> 'intake' AND model IN ({members}) AND MAE IS NOT NULL) WHERE rn = 1"""


block("first_winner", winners("'naive', 'exponential_smoothing'", "first_model"))
block("second_winner", winners("'seasonal_naive', 'moving_average'", "second_model"))
block("pairs", """
    SELECT a.series_id, a.metric, a.horizon, first_model, second_model FROM first_winner a
    JOIN second_winner b ON b.series_id = a.series_id AND b.metric = a.metric AND b.horizon = a.horizon""")
POINT = "series_id, metric, window_rule, fold_id, horizon"
block("ens", f"""
    SELECT {PRED_COLUMNS.replace("model, ", "'ensemble' AS model, ").replace("y_pred, ", "(y_pred + other) / 2 AS y_pred, ")},
        first_model || ' + ' || second_model AS ensemble_components
    FROM (SELECT a.*, p.first_model, p.second_model, b.y_pred AS other
          FROM pred a
          JOIN pairs p ON p.series_id = a.series_id AND p.metric = a.metric AND p.horizon = a.horizon AND p.first_model = a.model
          JOIN pred b ON b.series_id = a.series_id AND b.metric = a.metric AND b.window_rule = a.window_rule
              AND b.fold_id = a.fold_id AND b.horizon = a.horizon AND b.model = p.second_model)""")
block("comb_rows", f"SELECT {PRED_COLUMNS} FROM pred WHERE metric <> 'intake' UNION ALL SELECT {PRED_COLUMNS} FROM ens")
block("comb", f"""
    SELECT *, bool_and(y_true IS NOT NULL AND y_pred IS NOT NULL AND y_true_is_observed)
        OVER (PARTITION BY {POINT}) AS common_support FROM comb_rows""")
block("cscoped", scopes("comb"))
block("cmetrics", measures("cscoped", f"fold_scope, {CELL}"))


# ------------------------------------------------------------------ selection
def selection_blocks(p: str, condition: str) -> None:
    cell = "series_id, metric, horizon"
    block(f"{p}points", f"""
        SELECT * FROM comb WHERE window_rule = 'capped' AND common_support AND y_true_is_observed AND {condition}""")
    block(f"{p}maes", f"""
        SELECT {cell}, model, avg(abs(y_true - y_pred)) AS MAE, count(*) AS n_points,
            CAST(list_position({ORDER}, model) - 1 AS INTEGER) AS rank,
            model IN ('naive', 'seasonal_naive', 'moving_average') AS is_baseline
        FROM {p}points GROUP BY {cell}, model""")
    block(f"{p}viable", f"""
        SELECT *, is_baseline OR coalesce(MAE < min(CASE WHEN model IN ('naive', 'seasonal_naive') THEN MAE END)
            OVER (PARTITION BY {cell}), false) AS viable FROM {p}maes""")
    block(f"{p}judged", f"""
        SELECT *, bool_or(viable AND NOT is_baseline) OVER (PARTITION BY {cell}) AS any_passed,
            first_value(model) OVER (PARTITION BY {cell} ORDER BY viable DESC, MAE, rank, model) AS leader_model,
            first_value(MAE) OVER (PARTITION BY {cell} ORDER BY viable DESC, MAE, rank, model) AS leader_mae,
            first_value(model) OVER (PARTITION BY {cell} ORDER BY is_baseline DESC, MAE, rank, model) AS best_baseline
        FROM {p}viable""")
    block(f"{p}errors", f"""
        SELECT a.series_id, a.metric, a.horizon, a.model, a.fold_id, a.y_pred - a.y_true AS signed,
            abs(a.y_pred - a.y_true) - abs(l.y_pred - l.y_true) AS d, abs(a.y_pred - a.y_true) AS error,
            row_number() OVER (PARTITION BY a.series_id, a.metric, a.horizon, a.model ORDER BY a.fold_id) - 1 AS i,
            count(*) OVER (PARTITION BY a.series_id, a.metric, a.horizon, a.model) AS n
        FROM {p}points a
        JOIN {p}judged j ON j.series_id = a.series_id AND j.metric = a.metric AND j.horizon = a.horizon AND j.model = a.model
        JOIN {p}points l ON l.series_id = a.series_id AND l.metric = a.metric AND l.horizon = a.horizon
            AND l.fold_id = a.fold_id AND l.model = j.leader_model""")
    block(f"{p}draws", draws(f"(SELECT DISTINCT n FROM {p}errors)"))
    block(f"{p}means", f"""
        SELECT e.series_id, e.metric, e.horizon, e.model, w.rep, avg(e.d) AS md, avg(e.signed) AS ms
        FROM {p}errors e JOIN {p}draws w ON w.n = e.n AND w.idx = e.i GROUP BY 1, 2, 3, 4, 5""")
    block(f"{p}evid", f"""
        SELECT j.*, x.mean_difference, c.diff_low, c.diff_high,
            c.diff_low > 1e-9 * greatest(abs(c.diff_low), abs(c.diff_high)) OR c.diff_high < -1e-9 * greatest(abs(c.diff_low), abs(c.diff_high)) AS distinguishable,
            x.bias, abs(x.bias) / nullif(MAE, 0) AS bias_ratio, c.bias_low, c.bias_high,
            c.bias_low > 1e-9 * greatest(abs(c.bias_low), abs(c.bias_high)) OR c.bias_high < -1e-9 * greatest(abs(c.bias_low), abs(c.bias_high)) AS bias_significant,
            x.q50 AS error_median, x.q75 - x.q25 AS error_iqr, x.q90 AS error_p90, x.q90 / nullif(x.q50, 0) AS tail_ratio
        FROM {p}judged j
        JOIN (SELECT series_id, metric, horizon, model, avg(d) AS mean_difference, avg(signed) AS bias,
                  quantile_cont(error, 0.25) AS q25, quantile_cont(error, 0.5) AS q50,
                  quantile_cont(error, 0.75) AS q75, quantile_cont(error, 0.9) AS q90
              FROM {p}errors GROUP BY 1, 2, 3, 4) x
            ON x.series_id = j.series_id AND x.metric = j.metric AND x.horizon = j.horizon AND x.model = j.model
        JOIN (SELECT series_id, metric, horizon, model, quantile_cont(md, 0.025) AS diff_low, quantile_cont(md, 0.975) AS diff_high,
                  quantile_cont(ms, 0.025) AS bias_low, quantile_cont(ms, 0.975) AS bias_high
              FROM {p}means GROUP BY 1, 2, 3, 4) c
            ON c.series_id = j.series_id AND c.metric = j.metric AND c.horizon = j.horizon AND c.model = j.model""")
    block(f"{p}tied", f"""
        SELECT *, tied AND any_passed AND bias_significant AND coalesce(bias_ratio > 0.5, false) AS screened
        FROM (SELECT *, CASE WHEN any_passed THEN viable AND (model = leader_model OR NOT distinguishable)
                             ELSE model = best_baseline END AS tied FROM {p}evid)""")
    block(f"{p}champions", f"""
        SELECT *, CASE WHEN NOT any_passed THEN 'baseline_unbeaten'
            WHEN champion = numerical_leader THEN 'leader_untied'
            ELSE 'simplest_tied' END AS reason
        FROM (SELECT {cell}, any_value(any_passed) AS any_passed,
                coalesce(arg_min(model, rank) FILTER (WHERE tied AND NOT screened), arg_min(model, rank) FILTER (WHERE tied)) AS champion,
                coalesce(arg_min(MAE, rank) FILTER (WHERE tied AND NOT screened), arg_min(MAE, rank) FILTER (WHERE tied)) AS champion_mae,
                CASE WHEN any_value(any_passed) THEN any_value(leader_model) END AS numerical_leader,
                CASE WHEN any_value(any_passed) THEN any_value(leader_mae) END AS numerical_leader_mae,
                coalesce(string_agg(model, ',' ORDER BY model) FILTER (WHERE viable AND NOT is_baseline), '') AS gate_cleared_by,
                coalesce(string_agg(model, ',' ORDER BY rank) FILTER (WHERE tied), '') AS tied_with_best,
                coalesce(string_agg(model, ',' ORDER BY rank) FILTER (WHERE screened), '') AS bias_screened_out,
                max(n_points) AS n_scored
              FROM {p}tied GROUP BY {cell})""")


def draws(sizes: str, resamples: int = 10_000, seed: int = 42) -> str:
    """The portable draws: one index per (n, replicate, draw)."""
    return f"""
        SELECT n, rep, c % n AS idx FROM (
            SELECT n, rep, (b * b + draw * 17 + 3) % {M31} AS c FROM (
                SELECT n, rep, draw, (a * a + rep * 31 + 1) % {M31} AS b FROM (
                    SELECT n, rep, draw, (rep * 7919 + draw * 104729 + {seed}) % {M31} AS a
                    FROM (SELECT n, unnest(range({resamples})) AS rep FROM {sizes}) r,
                         LATERAL (SELECT unnest(range(r.n)) AS draw))))"""


selection_blocks("", "origin_post_cutoff")
selection_blocks("f_", "true")

# ------------------------------------------------------------------ residuals, intervals
RESID = (
    "series_id, metric, model, window_rule, fold_id, origin_pos, origin_date, origin_post_cutoff, horizon, "
    "effective_lead, test_pos, test_date, y_true, y_pred, y_true - y_pred AS residual, abs(y_true - y_pred) AS abs_residual"
)
SCORABLE = "y_true IS NOT NULL AND y_pred IS NOT NULL AND y_true_is_observed"
block("resid", f"SELECT {RESID} FROM pred WHERE {SCORABLE} UNION ALL SELECT {RESID} FROM ens WHERE {SCORABLE}")
block("pool", "SELECT * FROM resid WHERE window_rule = 'capped' AND origin_post_cutoff")
block("quant", """
    SELECT series_id, metric, horizon, model, count(residual) AS n_residuals,
        quantile_cont(residual, 0.025) AS q_low, quantile_cont(residual, 0.975) AS q_high
    FROM pool GROUP BY 1, 2, 3, 4""")
block("numbered", """
    SELECT *, row_number() OVER (PARTITION BY series_id, metric, horizon, model ORDER BY fold_id) AS id,
        count(*) OVER (PARTITION BY series_id, metric, horizon, model) AS n FROM pool""")
block("loo", """
    SELECT series_id, metric, horizon, model, count(*) AS n, count(CASE WHEN residual BETWEEN lo AND hi THEN 1 END) AS n_covered
    FROM (SELECT a.series_id, a.metric, a.horizon, a.model, a.id, any_value(a.residual) AS residual,
              quantile_cont(b.residual, 0.025) AS lo, quantile_cont(b.residual, 0.975) AS hi
          FROM numbered a JOIN numbered b ON b.series_id = a.series_id AND b.metric = a.metric AND b.horizon = a.horizon
              AND b.model = a.model AND b.id <> a.id
          WHERE a.n >= 3 GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""")


def band(counts: str) -> str:
    z = "CAST(1.96 AS DOUBLE)"
    p = "(CAST(n_covered AS DOUBLE) / nullif(n, 0))"
    return f"""
        SELECT *, coalesce(CAST(0.95 AS DOUBLE) BETWEEN band_low AND band_high, false) AS covers_nominal,
            CASE WHEN n = 0 THEN 'no_scorable_points' WHEN n < 40 THEN 'small_sample:' || n ELSE '' END AS note
        FROM (SELECT *, {p} AS empirical_coverage, CAST(0.95 AS DOUBLE) AS nominal_coverage,
            CASE WHEN n > 0 THEN greatest(CAST(0 AS DOUBLE), ({p} + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)
                - {z} * sqrt({p} * (1 - {p}) / n + {z} * {z} / (4 * CAST(n AS DOUBLE) * n)) / (1 + {z} * {z} / n)) END AS band_low,
            CASE WHEN n > 0 THEN least(CAST(1 AS DOUBLE), ({p} + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)
                + {z} * sqrt({p} * (1 - {p}) / n + {z} * {z} / (4 * CAST(n AS DOUBLE) * n)) / (1 + {z} * {z} / n)) END AS band_high
        FROM ({counts}))"""


block("champ_loo", """
    SELECT l.* FROM loo l JOIN champions c ON c.series_id = l.series_id AND c.metric = l.metric
        AND c.horizon = l.horizon AND c.champion = l.model""")
block("coverage", band("SELECT * FROM champ_loo"))

# requests under the rule without a floor
PLAIN = "CASE WHEN r.train_cutoff_pos >= r.cutoff_pos THEN r.cutoff_pos ELSE 0 END"
block("fwd_ask", """
    SELECT r.series_id, s.metric, 0 AS fold_id, h.horizon, r.last_real_pos AS origin_pos, m.ds AS origin_date,
        r.last_real_pos AS train_cutoff_pos, CASE WHEN r.last_real_pos >= r.cutoff_pos THEN r.cutoff_pos ELSE 0 END AS train_start_pos,
        h.horizon AS effective_lead, s.lp, s.lv, r.last_real_pos + h.horizon AS test_pos, NULL::DATE AS test_date
    FROM bounds r JOIN state s ON s.series_id = r.series_id AND s.train_cutoff_pos = r.last_real_pos
    JOIN master m ON m.series_id = r.series_id AND m.pos = r.last_real_pos
    CROSS JOIN (VALUES (1), (7), (14)) h(horizon)""")


def plain_ask(table: str) -> str:
    return f"""
        SELECT r.series_id, s.metric, r.fold_id, r.horizon, r.origin_pos, r.origin_date, r.train_cutoff_pos,
            {PLAIN} AS train_start_pos, r.effective_lead, s.lp, s.lv, r.test_pos, r.test_date
        FROM {table} r JOIN state s ON s.series_id = r.series_id AND s.train_cutoff_pos = r.train_cutoff_pos"""


block("hold_ask", plain_ask("hfolds"))
block("dev_ask", plain_ask("folds"))
for _ask in ("fwd", "hold", "dev"):
    forecast_blocks("", f"{_ask}_ask", f"{_ask}_made", 7)
    block(f"{_ask}_points", f"""
        SELECT series_id, metric, horizon, model, fold_id, origin_pos, origin_date, test_pos, test_date, train_start_pos, train_cutoff_pos, y_pred
        FROM {_ask}_made
        UNION ALL
        SELECT a.series_id, a.metric, a.horizon, 'ensemble', a.fold_id, a.origin_pos, a.origin_date, a.test_pos, a.test_date,
            a.train_start_pos, a.train_cutoff_pos, (a.y_pred + b.y_pred) / 2
        FROM {_ask}_made a
        JOIN pairs p ON p.series_id = a.series_id AND p.metric = a.metric AND p.horizon = a.horizon AND p.first_model = a.model
        JOIN {_ask}_made b ON b.series_id = a.series_id AND b.metric = a.metric AND b.horizon = a.horizon
            AND b.origin_pos = a.origin_pos AND b.model = p.second_model""")


def interval(rows: str, floor: bool) -> str:
    """Attach the empirical interval to rows with ``point_forecast``."""
    clip = "coalesce(raw_low < 0, false)" if floor else "false"
    return f"""
        SELECT *, upper - lower AS interval_width FROM (
            SELECT *, raw_low AS lower_unclipped, {clip} AS clipped_at_floor,
                CASE WHEN {clip} THEN CAST(0 AS DOUBLE) ELSE raw_low END AS lower, raw_high AS upper,
                CASE WHEN nres < 10 THEN 'few_residuals:' || nres
                     WHEN point_forecast IS NULL THEN 'forecast_missing' ELSE '' END AS interval_note
            FROM (SELECT r.*, coalesce(q.n_residuals, 0) AS nres,
                    coalesce(q.n_residuals, 0) >= 10 AND r.point_forecast IS NOT NULL AS enough,
                    CASE WHEN coalesce(q.n_residuals, 0) >= 10 THEN r.point_forecast + q.q_low END AS raw_low,
                    CASE WHEN coalesce(q.n_residuals, 0) >= 10 THEN r.point_forecast + q.q_high END AS raw_high
                  FROM ({rows}) r LEFT JOIN quant q ON q.series_id = r.series_id AND q.metric = r.metric
                      AND q.horizon = r.horizon AND q.model = r.model))"""


block("forward", interval("""
    SELECT p.series_id, p.metric, p.horizon, p.model, coalesce(p.model = c.champion, false) AS is_champion, c.champion,
        p.origin_pos, p.origin_date, p.origin_pos + p.horizon AS forecast_pos, p.y_pred AS point_forecast,
        p.train_start_pos, p.origin_pos - p.train_start_pos + 1 AS train_n_positions
    FROM fwd_points p LEFT JOIN champions c ON c.series_id = p.series_id AND c.metric = p.metric AND c.horizon = p.horizon
    WHERE p.metric <> 'intake'""", True))
block("holdout", f"""
    SELECT series_id, metric, horizon, model AS champion, fold_id, origin_pos, origin_date, test_pos, test_date, y_true, point_forecast,
        lower, upper, CASE WHEN enough THEN y_true BETWEEN lower AND upper END AS covered, abs(y_true - point_forecast) AS abs_error
    FROM ({interval('''
        SELECT p.series_id, p.metric, p.horizon, p.model, p.fold_id, p.origin_pos, p.origin_date, p.test_pos, p.test_date,
            a.value AS y_true, p.y_pred AS point_forecast
        FROM hold_points p
        JOIN champions c ON c.series_id = p.series_id AND c.metric = p.metric AND c.horizon = p.horizon AND c.champion = p.model
        JOIN panel a ON a.series_id = p.series_id AND a.metric = p.metric AND a.pos = p.test_pos
        WHERE NOT a.is_imputed AND a.value IS NOT NULL''', False)})""")

# ------------------------------------------------------------------ imbalance
block("component", """
    SELECT * FROM resid WHERE metric = 'intake' AND model IN ('seasonal_naive', 'moving_average')
        AND origin_post_cutoff AND window_rule = 'capped'""")


def paired(component: str, target: str) -> str:
    return f"""
        SELECT a.series_id, a.model AS component_model, b.model AS target_model, a.horizon, a.residual AS a, b.residual AS b
        FROM {component} a JOIN {target} b ON b.series_id = a.series_id AND b.window_rule = a.window_rule
            AND b.fold_id = a.fold_id AND b.horizon = a.horizon"""


MOMENTS = (
    "count(*) AS n_paired, nullif(corr(a, b), 'nan'::DOUBLE) AS correlation, covar_samp(a, b) AS covariance, "
    "var_samp(a) AS var_component, var_samp(b) AS var_target"
)
block("component_stats", f"""
    SELECT series_id, component_model, target_model, horizon, n_paired,
        CASE WHEN n_paired >= 3 THEN var_component END AS var_component, CASE WHEN n_paired >= 3 THEN var_target END AS var_target,
        CASE WHEN n_paired >= 3 AND NOT isnan(correlation) THEN correlation END AS correlation,
        CASE WHEN n_paired >= 3 THEN covariance ELSE 0 END AS covariance
    FROM (SELECT series_id, component_model, target_model, horizon, {MOMENTS}
          FROM ({paired("component", "(SELECT * FROM pool WHERE metric = 'release')")}) GROUP BY 1, 2, 3, 4)""")
block("imbalance", """
    SELECT *, sqrt(variance) AS std, net_pressure - sqrt(variance) AS lower_1sd, net_pressure + sqrt(variance) AS upper_1sd,
        CASE WHEN net_pressure > 0 THEN 'inflow_exceeds' ELSE 'outflow_exceeds' END AS interpretation
    FROM (SELECT i.series_id, i.horizon, i.origin_date, i.model AS component_model, i.y_pred AS component_forecast,
            o.model AS target_model, o.y_pred AS target_forecast, i.y_pred - o.y_pred AS net_pressure,
            CASE WHEN abs(s.correlation) < 0.2 THEN 'independence' ELSE 'full_covariance' END AS uncertainty_form,
            greatest(CASE WHEN abs(s.correlation) < 0.2 THEN s.var_component + s.var_target
                          ELSE s.var_component + s.var_target - 2 * s.covariance END,
                     CASE WHEN s.var_component IS NOT NULL AND s.var_target IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS variance,
            s.correlation AS measured_correlation, coalesce(s.n_paired, 0) AS n_paired_residuals, s.var_component, s.var_target
          FROM fwd_points i
          JOIN champions c ON c.series_id = i.series_id AND c.metric = 'release' AND c.horizon = i.horizon
          JOIN fwd_points o ON o.series_id = i.series_id AND o.metric = 'release' AND o.horizon = i.horizon AND o.model = c.champion
          LEFT JOIN component_stats s ON s.series_id = i.series_id AND s.horizon = i.horizon
              AND s.component_model = i.model AND s.target_model = c.champion
          WHERE i.metric = 'intake' AND i.model = 'seasonal_naive')""")

# ------------------------------------------------------------------ early warning
block("thresholds", """
    SELECT series_id, metric, pos, quantile_cont(CASE WHEN NOT is_imputed THEN value END, 0.9)
        OVER (PARTITION BY series_id, metric ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS threshold
    FROM panel WHERE metric <> 'intake'""")
block("watch_origins", "SELECT DISTINCT series_id, origin_pos FROM folds")
block("watch", f"""
    SELECT t.series_id, t.metric, t.origin_pos, t.percentile, t.threshold, min(q.pos) - t.origin_pos AS crossing_offset
    FROM (SELECT o.series_id, o.origin_pos, p.metric, l.percentile, quantile_cont(CASE WHEN NOT p.is_imputed THEN p.value END, l.percentile) AS threshold
          FROM watch_origins o JOIN panel p ON p.series_id = o.series_id AND p.metric <> 'intake' AND p.pos BETWEEN o.origin_pos - 59 AND o.origin_pos
          CROSS JOIN {LEVELS} l(percentile) GROUP BY 1, 2, 3, 4) t
    LEFT JOIN panel q ON q.series_id = t.series_id AND q.metric = t.metric AND q.pos BETWEEN t.origin_pos + 1 AND t.origin_pos + 14
        AND NOT q.is_imputed AND q.value > t.threshold
    GROUP BY 1, 2, 3, 4, 5""".replace("quantile_cont(CASE WHEN NOT p.is_imputed THEN p.value END, l.percentile)",
    "CASE l.percentile " + " ".join(
        f"WHEN CAST({q} AS DOUBLE) THEN quantile_cont(CASE WHEN NOT p.is_imputed THEN p.value END, {q})" for q in ("0.75", "0.80", "0.85", "0.90", "0.95")
    ) + " END"))
TIER = "CASE {h} WHEN 1 THEN 'Alert' WHEN 7 THEN 'Warning' WHEN 14 THEN 'Watch' END"
block("fires", """
    SELECT p.series_id, p.metric, p.fold_id, p.origin_pos, p.origin_date, w.percentile, w.threshold, w.crossing_offset,
        min(CASE WHEN p.y_pred > w.threshold THEN p.horizon END) AS short, max(CASE WHEN p.y_pred > w.threshold THEN p.horizon END) AS long,
        coalesce(string_agg(CASE WHEN p.y_pred > w.threshold THEN CAST(p.horizon AS VARCHAR) END, ',' ORDER BY p.horizon), '') AS fired_horizons,
        max(CASE WHEN p.horizon = 1 THEN p.y_pred END) AS forecast_h1, max(CASE WHEN p.horizon = 7 THEN p.y_pred END) AS forecast_h7,
        max(CASE WHEN p.horizon = 14 THEN p.y_pred END) AS forecast_h14
    FROM dev_points p
    JOIN champions c ON c.series_id = p.series_id AND c.metric = p.metric AND c.horizon = p.horizon AND c.champion = p.model
    JOIN watch w ON w.series_id = p.series_id AND w.metric = p.metric AND w.origin_pos = p.origin_pos
    GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
block("grid", f"""
    SELECT *, CASE WHEN outcome = 'true_positive' THEN crossing_offset END AS lead_time
    FROM (SELECT *, short IS NOT NULL AS fired, {TIER.format(h="short")} AS highest_tier, {TIER.format(h="long")} AS earliest_tier,
            CASE WHEN threshold IS NULL THEN NULL
                 WHEN short IS NOT NULL AND crossing_offset IS NOT NULL THEN 'true_positive' WHEN short IS NOT NULL THEN 'false_positive'
                 WHEN crossing_offset IS NOT NULL THEN 'false_negative' ELSE 'true_negative' END AS outcome FROM fires)""")
block("backtest", "SELECT * FROM grid WHERE percentile = CAST(0.90 AS DOUBLE)")


def summary(table: str, keys: str) -> str:
    return f"""
        SELECT *, true_positive + false_positive AS n_fired,
            false_positive / nullif(CAST(true_positive + false_positive AS DOUBLE), 0) AS false_positive_rate,
            false_negative / nullif(CAST(true_negative + false_negative AS DOUBLE), 0) AS false_negative_rate,
            true_positive / nullif(CAST(true_positive + false_positive AS DOUBLE), 0) AS precision
        FROM (SELECT {keys}, count(*) AS n_origins,
                count(CASE WHEN outcome = 'true_positive' THEN 1 END) AS true_positive,
                count(CASE WHEN outcome = 'false_positive' THEN 1 END) AS false_positive,
                count(CASE WHEN outcome = 'false_negative' THEN 1 END) AS false_negative,
                count(CASE WHEN outcome = 'true_negative' THEN 1 END) AS true_negative,
                quantile_cont(CAST(lead_time AS DOUBLE), 0.5) AS median_surge_lead_time, min(lead_time) AS min_surge_lead_time,
                max(lead_time) AS max_surge_lead_time
              FROM {table} WHERE outcome IS NOT NULL GROUP BY {keys})"""


block("warning_summary", summary("backtest", "series_id, metric"))


# ------------------------------------------------------------------ smoothing over the whole grid
def _cross(**axes: tuple) -> str:
    """A grid as rows with its place; the last axis runs fastest."""
    names = list(axes)
    return (
        f"SELECT row_number() OVER (ORDER BY {', '.join(names)}) - 1 AS place, * FROM "
        + " CROSS JOIN ".join(f"(VALUES {', '.join(f'({v}::DOUBLE)' for v in axes[n])}) {n}_({n})" for n in names)
    )


def smoothing_blocks(specs: dict, m: int) -> None:
    """Every grid point stepped through every history by recursion; the best state of each cutoff, and its forecasts."""
    points = " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, {str(s.trend).lower()} AS trend, * FROM ("
        + _cross(alpha=s.alphas, beta=s.betas if s.trend else (0.0,), gamma=s.gammas, phi=s.phis if s.trend and s.damped else (1.0,)) + ")"
        for metric, s in specs.items()
    )
    block("hw_grid", points)
    block("hw_asked", "SELECT DISTINCT series_id, metric, train_start_pos, train_cutoff_pos FROM req WHERE metric <> 'intake'")
    block("hw_counts", """
        SELECT a.*, count(q.value) AS n FROM hw_asked a JOIN panel q ON q.series_id = a.series_id AND q.metric = a.metric
            AND q.pos BETWEEN a.train_start_pos AND a.train_cutoff_pos GROUP BY ALL""")
    block("hw_hist", """
        SELECT a.series_id, a.metric, a.train_start_pos, list(q.value::DOUBLE ORDER BY q.pos) AS y
        FROM (SELECT DISTINCT series_id, metric, train_start_pos FROM hw_asked) a JOIN panel q ON q.series_id = a.series_id AND q.metric = a.metric
            AND q.pos >= a.train_start_pos WHERE q.value IS NOT NULL GROUP BY 1, 2, 3""")
    block("hw_steps", f"""
        SELECT * FROM (WITH RECURSIVE z AS (
            SELECT series_id, metric, train_start_pos, place, trend, alpha, beta, gamma, phi, 0 AS n, list_avg(y[1:{m}]) AS level,
                CASE WHEN trend THEN (list_avg(y[{m + 1}:{2 * m}]) - list_avg(y[1:{m}])) / {m} ELSE 0.0::DOUBLE END AS slope,
                list_transform(y[1:{m}], lambda v: v - list_avg(y[1:{m}])) AS s, 0.0::DOUBLE AS sse
            FROM hw_hist JOIN hw_grid USING (metric)
            UNION ALL
            SELECT series_id, metric, train_start_pos, place, trend, alpha, beta, gamma, phi, n + 1, level + phi * slope + alpha * e,
                CASE WHEN trend THEN phi * slope + alpha * beta * e ELSE slope END,
                list_append(s[2:], s[1] + gamma * (1 - alpha) * e), CASE WHEN n >= {m} THEN sse + e * e ELSE sse END
            FROM (SELECT z.*, h.y[n + 1] - (level + phi * slope + s[1]) AS e FROM z
                  JOIN hw_hist h ON h.series_id = z.series_id AND h.metric = z.metric AND h.train_start_pos = z.train_start_pos WHERE n < len(h.y))
        ) SELECT * FROM z)""")
    block("hw_best", f"""
        SELECT c.series_id, c.metric, c.train_start_pos, c.train_cutoff_pos, c.n, arg_min(z, (z.sse, z.place)) AS z
        FROM hw_counts c JOIN hw_steps z ON z.series_id = c.series_id AND z.metric = c.metric AND z.train_start_pos = c.train_start_pos AND z.n = c.n
        WHERE c.n >= {2 * m + 4} GROUP BY 1, 2, 3, 4, 5""")
    damped = "list_sum(list_transform(range(1, {k} + 1), lambda i: pow(phi, i)))"
    weight = f"alpha + CASE WHEN trend THEN alpha * beta * {damped.format(k='j')} ELSE 0 END + CASE WHEN j % {m} = 0 THEN gamma * (1 - alpha) ELSE 0 END"
    block("hw_leads", f"""
        SELECT c.series_id, c.metric, c.train_start_pos, c.train_cutoff_pos, c.n, l.effective_lead, z.z.* 
        FROM hw_counts c JOIN (SELECT DISTINCT series_id, metric, train_start_pos, train_cutoff_pos, effective_lead FROM req) l
            ON l.series_id = c.series_id AND l.metric = c.metric AND l.train_start_pos = c.train_start_pos AND l.train_cutoff_pos = c.train_cutoff_pos
        LEFT JOIN hw_best z ON z.series_id = c.series_id AND z.metric = c.metric AND z.train_start_pos = c.train_start_pos AND z.train_cutoff_pos = c.train_cutoff_pos""".replace("z.z.*", "z.z.trend, z.z.alpha, z.z.beta, z.z.gamma, z.z.phi, z.z.level, z.z.slope, z.z.s, z.z.sse"))
    block("hw_weights", f"""
        SELECT series_id, metric, train_start_pos, train_cutoff_pos, effective_lead, sum(w * w) AS spread
        FROM (SELECT *, {weight} AS w FROM (SELECT *, unnest(range(1, effective_lead)) AS j FROM hw_leads WHERE level IS NOT NULL)) GROUP BY ALL""")
    block("hw_made", f"""
        SELECT l.*, level + slope * {damped.format(k='l.effective_lead')} + s[(l.effective_lead - 1) % {m} + 1] AS hat,
            1.96 * sqrt(sse / greatest(n - {m}, 1) * (1 + coalesce(spread, 0))) AS half
        FROM hw_leads l LEFT JOIN hw_weights w ON w.series_id = l.series_id AND w.metric = l.metric AND w.train_start_pos = l.train_start_pos
            AND w.train_cutoff_pos = l.train_cutoff_pos AND w.effective_lead = l.effective_lead""")
    block("hw_pred", """
        SELECT r.series_id, r.metric, 'exponential_smoothing' AS model, r.window_rule, r.fold_id, r.horizon, r.effective_lead, a.value AS y_true,
            NOT a.is_imputed AND a.value IS NOT NULL AS observed, hat AS y_pred, hat - half AS y_pred_lo, hat + half AS y_pred_hi, level IS NULL AS fit_failed,
            false AS forecast_failed, CASE WHEN level IS NULL THEN 'insufficient observations (' || n || ' finite)' ELSE '' END AS failure_reason
        FROM req r JOIN panel a ON a.series_id = r.series_id AND a.metric = r.metric AND a.pos = r.test_pos
        JOIN hw_made h ON h.series_id = r.series_id AND h.metric = r.metric AND h.train_start_pos = r.train_start_pos
            AND h.train_cutoff_pos = r.train_cutoff_pos AND h.effective_lead = r.effective_lead""")


smoothing_blocks(Engine().smoothing, Engine().season)


# ------------------------------------------------------------------ assembly
def needed(text: str) -> list[str]:
    """Blocks mentioned by ``text``, dependencies first."""
    order: list[str] = []
    open_: list[str] = []

    def visit(body: str) -> None:
        for name in BLOCKS:
            if name not in order and name not in open_ and re.search(rf"(?:FROM|JOIN)\s+{name}\b", body):
                open_.append(name)
                visit(BLOCKS[name])
                order.append(name)

    visit(text)
    return order


def sql(select: str, rounded: str = "") -> str:
    """A complete statement; ``rounded`` names the floating-point result columns."""
    blocks = needed(select)
    head = ",\n".join(f"{b} AS MATERIALIZED ({BLOCKS[b].strip()})" for b in blocks)
    body = select.strip()
    if rounded:
        # the nudge keeps exact ties from falling differently after summation noise
        parts = ", ".join(f"round({c} + 1e-9, 6) + 0.0::DOUBLE AS {c}" for c in rounded.split())
        body = f"SELECT * REPLACE ({parts}) FROM ({body})"
    elif blocks and body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return (f"WITH {head}\n" if blocks else "") + body
