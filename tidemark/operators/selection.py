"""Champion per (series, metric, horizon) under a paired-bootstrap rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import BASELINES, COMMON, COMPLEXITY_ORDER, GATE_REFERENCES, Engine
from tidemark.functions.bootstrap import distinguishable, mean_interval
from tidemark.operators.scoring import scorable

KEY = ["series_id", "metric", "horizon"]

# Status codes recorded with a decision.
NO_FINITE = "no_finite_error"
BASELINE_WINS = "baseline_unbeaten"
SIMPLEST_TIED = "simplest_tied"
LEADER_WINS = "leader_untied"
AGREE = "scopes_agree"
DISAGREE = "scopes_differ"


def complexity_rank(model: Column) -> Column:
    """Position in the complexity order; an unknown model ranks last."""
    order = F.array(*[F.lit(m) for m in COMPLEXITY_ORDER])
    at = F.array_position(order, model)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(COMPLEXITY_ORDER))).cast("int")


def passes_gate(mae: Column, references: list[Column]) -> Column:
    """Strictly better than the better present reference; NULL never passes."""
    best = F.least(*references) if len(references) > 1 else references[0]
    return F.coalesce(mae < best, F.lit(False))


def paired_errors(predictions: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Absolute errors of two models on the same points, with a check that both
    saw the same actual."""
    def side(model: str, tag: str) -> DataFrame:
        return predictions.filter((F.col("model") == model) & scorable()).select(
            "series_id", "metric", "window_rule", "fold_id", "horizon",
            F.col("y_true").alias(f"y_{tag}"),
            F.abs(F.col("y_true") - F.col("y_pred")).alias(f"error_{tag}"),
        )

    keys = ["series_id", "metric", "window_rule", "fold_id", "horizon"]
    return (
        side(model_a, "a")
        .join(side(model_b, "b"), keys)
        .select(
            *keys, "error_a", "error_b",
            (F.abs(F.col("y_a") - F.col("y_b")) < 1e-8).alias("same_actual"),
        )
    )


def paired_bootstrap(pairs: DataFrame, engine: Engine) -> DataFrame:
    """Interval of mean(error_a - error_b) per cell and rule."""
    cells = pairs.groupBy("series_id", "metric", "window_rule", "horizon").agg(
        F.array_sort(
            F.collect_list(F.struct("fold_id", (F.col("error_a") - F.col("error_b")).alias("d")))
        ).alias("pairs")
    )
    d = F.transform("pairs", lambda x: x["d"])
    ci = mean_interval(d, engine.draws, engine.resamples, engine.confidence, engine.seed)
    return (
        cells.select("series_id", "metric", "window_rule", "horizon", d.alias("d"), ci.alias("ci"))
        .select(
            "series_id", "metric", "window_rule", "horizon",
            F.size("d").cast("bigint").alias("n"),
            F.try_divide(
                F.aggregate("d", F.lit(0.0), lambda a, x: a + x), F.size("d").cast("double")
            ).alias("mean_difference"),
            F.col("ci.ci_low").alias("ci_low"),
            F.col("ci.ci_high").alias("ci_high"),
        )
        .withColumn("distinguishable", distinguishable(F.col("ci_low"), F.col("ci_high")))
        .withColumn("practically_equivalent", ~F.col("distinguishable"))
    )


def bias_diagnostics(points: DataFrame, engine: Engine, keys: list[str]) -> DataFrame:
    """Signed bias, its share of the typical error, and whether it is significant."""
    arrays = points.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("fold_id", (F.col("y_pred") - F.col("y_true")).alias("e")))
            ),
            lambda x: x["e"],
        ).alias("e"),
        F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"),
        F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"),
    )
    ci = mean_interval(F.col("e"), engine.draws, engine.resamples, engine.confidence, engine.seed)
    return (
        arrays.withColumn("ci", ci)
        .select(
            *keys,
            F.size("e").cast("bigint").alias("n"),
            "bias",
            "mae",
            F.try_divide(F.abs("bias"), F.nullif(F.col("mae"), F.lit(0.0))).alias("bias_ratio"),
            F.col("ci.ci_low").alias("ci_low"),
            F.col("ci.ci_high").alias("ci_high"),
        )
        .withColumn("significant", distinguishable(F.col("ci_low"), F.col("ci_high")))
    )


def stability_diagnostics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Spread and tail of the absolute error across folds."""
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    return (
        points.groupBy(*keys)
        .agg(
            F.count(error).alias("n"),
            F.percentile(error, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)])).alias("q"),
        )
        .filter("n > 0")
        .select(
            *keys,
            "n",
            F.col("q")[1].alias("error_median"),
            (F.col("q")[2] - F.col("q")[0]).alias("error_iqr"),
            F.col("q")[3].alias("error_p90"),
            F.try_divide(F.col("q")[3], F.nullif(F.col("q")[1], F.lit(0.0))).alias("tail_ratio"),
        )
    )


def scope_points(predictions: DataFrame, scope: str, engine: Engine) -> DataFrame:
    """Scorable common-support points of the deployed rule, within a scope."""
    keep = (
        (F.col("window_rule") == engine.selection_rule)
        & F.col("common_support")
        & F.col("y_true_is_observed")
    )
    if scope != COMMON:
        keep = keep & F.col("origin_post_cutoff")
    return predictions.filter(keep)


def candidate_evidence(points: DataFrame, engine: Engine) -> DataFrame:
    """One row per cell and model: error, gate, leader, paired interval, bias, spread.

    The leader's error reaches the other models of the same point through a
    window over that point, so no model is joined with every other.
    """
    cell, cell_model = Window.partitionBy(*KEY), [*KEY, "model"]
    maes = points.groupBy(*cell_model).agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("MAE"),
        F.count(F.lit(1)).alias("n_points"),
    )
    reference = F.min(F.when(F.col("model").isin(*GATE_REFERENCES), F.col("MAE"))).over(cell)
    is_base = F.col("model").isin(*BASELINES)
    viable = (is_base & F.col("MAE").isNotNull()) | F.coalesce(F.col("MAE") < reference, F.lit(False))
    ranked = maes.select(
        *cell_model, "MAE", "n_points",
        complexity_rank(F.col("model")).alias("rank"),
        is_base.alias("is_baseline"),
        viable.alias("viable"),
    )
    best_first = F.struct("MAE", "rank", "model")
    judged = ranked.select(
        "*",
        F.bool_or(F.col("viable") & ~F.col("is_baseline")).over(cell).alias("any_passed"),
        F.min(F.when(F.col("viable"), best_first)).over(cell).alias("leader"),
        F.min(F.when(F.col("is_baseline"), best_first)).over(cell).alias("best_baseline"),
    )
    point = Window.partitionBy(*KEY, "fold_id")
    errors = points.join(
        judged.select(*cell_model, F.col("leader.model").alias("leader_model")), cell_model
    ).select(
        *cell_model,
        "fold_id",
        (F.col("y_pred") - F.col("y_true")).alias("signed"),
        F.abs(F.col("y_pred") - F.col("y_true")).alias("error"),
        F.max(
            F.when(F.col("model") == F.col("leader_model"), F.abs(F.col("y_pred") - F.col("y_true")))
        ).over(point).alias("leader_error"),
    )
    arrays = errors.groupBy(*cell_model).agg(
        F.array_sort(
            F.collect_list(
                F.struct("fold_id", (F.col("error") - F.col("leader_error")).alias("d"), "signed")
            )
        ).alias("a"),
        F.avg(F.col("error") - F.col("leader_error")).alias("mean_difference"),
        F.avg("signed").alias("bias"),
        F.percentile("error", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)])).alias("q"),
    )

    def ci(values: Column) -> Column:
        return mean_interval(values, engine.draws, engine.resamples, engine.confidence, engine.seed)

    tested = arrays.select(
        *cell_model, "mean_difference", "bias", "q",
        F.transform("a", lambda x: x["d"]).alias("d"),
        F.transform("a", lambda x: x["signed"]).alias("s"),
    ).select(*cell_model, "mean_difference", "bias", "q", ci(F.col("d")).alias("cd"), ci(F.col("s")).alias("cs"))
    out = judged.join(tested, cell_model).select(
        *cell_model, "MAE", "n_points", "rank", "is_baseline", "viable", "any_passed", "leader",
        "best_baseline", "mean_difference",
        F.col("cd.ci_low").alias("diff_low"), F.col("cd.ci_high").alias("diff_high"),
        distinguishable(F.col("cd.ci_low"), F.col("cd.ci_high")).alias("distinguishable"),
        "bias",
        F.try_divide(F.abs("bias"), F.nullif(F.col("MAE"), F.lit(0.0))).alias("bias_ratio"),
        F.col("cs.ci_low").alias("bias_low"), F.col("cs.ci_high").alias("bias_high"),
        distinguishable(F.col("cs.ci_low"), F.col("cs.ci_high")).alias("bias_significant"),
        F.col("q")[1].alias("error_median"),
        (F.col("q")[2] - F.col("q")[0]).alias("error_iqr"),
        F.col("q")[3].alias("error_p90"),
        F.try_divide(F.col("q")[3], F.nullif(F.col("q")[1], F.lit(0.0))).alias("tail_ratio"),
    )
    is_leader = F.col("model") == F.col("leader.model")
    tied = F.when(
        F.col("any_passed"), F.col("viable") & (is_leader | ~F.col("distinguishable"))
    ).otherwise(F.col("model") == F.col("best_baseline.model"))
    screened = F.col("any_passed") & F.coalesce(
        F.col("bias_significant") & (F.col("bias_ratio") > engine.bias_ratio_limit), F.lit(False)
    )
    return out.withColumn("tied", tied).withColumn("screened", F.col("tied") & screened)


def decide(evidence: DataFrame) -> DataFrame:
    """One decision per cell from the candidates' evidence.

    Among the tied, those without a significant large bias are preferred and the
    simplest of them wins; bias alone never removes the last one.
    """
    by_rank = F.struct("rank", "model")
    passed = F.first("any_passed")
    champion = F.coalesce(
        F.min(F.when(F.col("tied") & ~F.col("screened"), by_rank)), F.min(F.when(F.col("tied"), by_rank))
    )
    leader = F.when(passed, F.first("leader"))

    def names(keep: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, by_rank))), lambda x: x["model"])

    cells = evidence.groupBy(*KEY).agg(
        champion["model"].alias("champion"),
        leader["model"].alias("numerical_leader"),
        leader["MAE"].alias("numerical_leader_mae"),
        F.array_sort(F.collect_list(F.when(F.col("viable") & ~F.col("is_baseline"), F.col("model")))).alias(
            "gate_cleared_by"
        ),
        names(F.col("tied")).alias("tied_with_best"),
        names(F.col("screened")).alias("bias_screened_out"),
        F.max("n_points").alias("n_scored"),
        passed.alias("any_passed"),
        F.map_from_entries(F.collect_list(F.struct("model", "MAE"))).alias("maes"),
    )
    reason = (
        F.when(F.col("champion").isNull(), F.lit(NO_FINITE))
        .when(~F.col("any_passed"), F.lit(BASELINE_WINS))
        .when(F.col("champion") == F.col("numerical_leader"), F.lit(LEADER_WINS))
        .otherwise(F.lit(SIMPLEST_TIED))
    )
    return cells.select(
        *KEY, "champion", F.try_element_at("maes", F.col("champion")).alias("champion_mae"),
        "numerical_leader", "numerical_leader_mae", "gate_cleared_by", "tied_with_best",
        "bias_screened_out", "n_scored", reason.alias("reason"),
    )


def select_champions(predictions: DataFrame, engine: Engine, scope: str | None = None) -> DataFrame:
    """The rule applied to every cell of one scope."""
    points = scope_points(predictions, scope or engine.selection_scope, engine)
    return decide(candidate_evidence(points, engine))


def full_ranking(predictions: DataFrame, engine: Engine) -> DataFrame:
    """All models of a cell ordered by error on the whole development scope."""
    points = scope_points(predictions, COMMON, engine)
    maes = points.groupBy(*KEY, "model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("MAE"))
    return maes.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("MAE", "model"))).alias("full_dev_ranking")
    )


def two_scope_selection(predictions: DataFrame, engine: Engine) -> DataFrame:
    """Governing and full-development decisions side by side."""
    governing = select_champions(predictions, engine)
    full = select_champions(predictions, engine, COMMON).select(
        *KEY,
        F.col("champion").alias("champion_full_dev"),
        F.col("champion_mae").alias("champion_full_dev_mae"),
        F.col("numerical_leader").alias("full_dev_numerical_leader"),
        F.col("n_scored").alias("full_dev_n"),
    )
    agree = F.col("champion_full_dev").eqNullSafe(F.col("champion"))
    none = F.lit(0).cast("bigint")
    joined = governing.join(full, KEY, "full").join(full_ranking(predictions, engine), KEY, "left")
    # a cell without a scorable point in the governing scope still gets its row
    return (
        joined.withColumns({
            "reason": F.coalesce("reason", F.lit(NO_FINITE)),
            "n_scored": F.coalesce("n_scored", none),
            "full_dev_n": F.coalesce("full_dev_n", none),
        })
        .select(
            "*",
            agree.alias("rankings_agree"),
            F.when(agree, F.lit(AGREE)).otherwise(F.lit(DISAGREE)).alias("governing_scope_note"),
            F.lit(engine.selection_scope).alias("selection_scope"),
            F.lit(engine.selection_rule).alias("window_rule"),
        )
    )


def champion_for(champions: DataFrame, metric: str, horizon: int) -> DataFrame:
    return champions.filter((F.col("metric") == metric) & (F.col("horizon") == horizon))
