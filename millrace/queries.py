"""The queries of the screening engine, each over whole tables; oracles.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames
from .frames import CONTROL, MAX_LAG, PERIOD, TARGET, VARIABLES
from .operators import association, axis, causality, charts, filters, joins, preprocess, quality, ranking, residual, review, stability, stages, validation
from .oracles import ORACLE_SQL
from .plans.screening import Config, confirm, screen
from .plans.validation import validate
from .sources import tables
from .sources.staging import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def target_times(h: DataFrame) -> DataFrame:
    return h.where((F.col("variable") == TARGET) & F.col("value").isNotNull()).select("t")


def scores(spark, sf) -> DataFrame:
    return association.lag_scores(frames.hourly(spark, sf), TARGET, MAX_LAG, PERIOD, rows=frames.hours(spark, sf))


@query
def exclude_windows_stats(spark, sf):
    wide = frames.hourly_wide(spark, sf)
    return r6(filters.exclusion_stats(wide, frames.windows(wide)), "ratio")


@query
def exclude_conditions(spark, sf):
    rules = [{"column": "click", "operator": ">", "value": 60}, {"column": "error", "operator": "<", "value": 20}]
    return r6(filters.exclude(frames.hourly_wide(spark, sf), rules=rules).select("t", "click", "error"), "click", "error")


@query
def exclusion_gap_starts(spark, sf):
    wide = frames.hourly_wide(spark, sf)
    return filters.gap_starts(wide, filters.window_mask(frames.windows(wide)))


@query
def dedupe_keep_last(spark, sf):
    e = frames.read(spark, sf, "events").select(F.col("ts").cast("date").cast("timestamp_ntz").alias("day"), "event_id", "value")
    return r6(tables.load_series(e, "day", "event_id").select("t", "event_id", "value"), "value")


@query
def duplicate_timestamps(spark, sf):
    return tables.duplicate_times(frames.read(spark, sf, "lineitem"), "l_shipdate")


@query
def tercile_segment(spark, sf):
    return r6(filters.tercile_segment(frames.hourly_wide(spark, sf), CONTROL, "mid").select("t", CONTROL), CONTROL)


@query
def column_admission(spark, sf):
    return r6(filters.column_admission(frames.hourly(spark, sf), F.count(F.lit(1)), 0.93, [TARGET]), "valid_ratio")


@query
def lag_source_mask(spark, sf):
    wide = frames.hourly_wide(spark, sf)
    return filters.lag_sources(wide.select("t"), wide.where(F.col(CONTROL) > 60).select("t"), 3, PERIOD)


@query
def sample_period(spark, sf):
    return axis.sample_period(target_times(frames.hourly(spark, sf)))


@query
def segment_ids_exact(spark, sf):
    return axis.segment_ids(target_times(frames.hourly(spark, sf)), PERIOD)


@query
def segment_ids_tolerant(spark, sf):
    return axis.segment_ids(target_times(frames.hourly(spark, sf)), PERIOD, tolerance=2.5)


@query
def resample_median(spark, sf):
    return r6(axis.resample(frames.hourly(spark, sf), 10800), "value")


@query
def interpolate_time(spark, sf):
    return r6(preprocess.interpolate(frames.hourly(spark, sf), 2), "value")


@query
def ffill_limit(spark, sf):
    return r6(preprocess.forward_fill(frames.hourly(spark, sf), 2), "value")


@query
def standardize(spark, sf):
    return r6(preprocess.standardize(frames.hourly(spark, sf)).select("t", "variable", "value"), "value")


@query
def lowpass(spark, sf):
    return r6(preprocess.lowpass(frames.hourly(spark, sf), 90.0), "value")


@query
def detrend_centered(spark, sf):
    return r6(preprocess.detrend_centered(frames.hourly(spark, sf), 8), "value")


@query
def detrend_trailing(spark, sf):
    return r6(preprocess.detrend_trailing(frames.hourly(spark, sf), 8), "value")


@query
def diff_segment(spark, sf):
    h = frames.hourly(spark, sf)
    s = axis.segment_ids(target_times(h), PERIOD)
    return r6(preprocess.difference(h.join(s, "t"), 1, ["segment"]).select("t", "variable", "value"), "value")


@query
def diff_interval(spark, sf):
    h = frames.hourly(spark, sf)
    s = axis.segment_ids(target_times(h), PERIOD, tolerance=1.5)
    k = preprocess.diff_interval(150, PERIOD)
    return r6(preprocess.difference(h.join(s, "t"), k, ["segment"]).select("t", "variable", "value"), "value")


@query
def lag_pearson(spark, sf):
    return r6(scores(spark, sf).select("variable", "lag", "n", "pearson"), "pearson")


@query
def lag_spearman(spark, sf):
    return r6(scores(spark, sf).select("variable", "lag", "n", "spearman"), "spearman")


@query
def lag_p_and_q_values(spark, sf):
    return r6(association.with_q_values(association.with_p_values(scores(spark, sf))).select("variable", "lag", "pearson_p", "spearman_p", "pearson_q", "spearman_q"), "pearson_p", "spearman_p", "pearson_q", "spearman_q")


@query
def bh_adjust(spark, sf):
    p = scores(spark, sf).select("variable", "lag", (1 - F.col("abs_pearson")).alias("p"))
    return r6(association.benjamini_hochberg(p, "p", "q"), "p", "q")


@query
def best_lag(spark, sf):
    return r6(association.best_lags(scores(spark, sf)).select("variable", "lag", "n", "score", "method", "direction"), "score")


@query
def lag_peak_quality(spark, sf):
    p = association.peak_quality(scores(spark, sf), MAX_LAG)
    return r6(p.select("variable", "best_lag", "best_score", "peak_prominence", "lag_quality", "temporal_direction_status"), "best_score", "peak_prominence", "lag_quality")


@query
def diagnostics(spark, sf):
    return r6(quality.diagnostics(frames.hourly(spark, sf)), "missing_rate", "abnormal_jump_ratio", "robust_outlier_ratio", "saturation_ratio")


@query
def data_quality_score(spark, sf):
    return quality.diagnostics(frames.hourly(spark, sf)).select("variable", F.round(quality.quality_score(), 6).alias("data_quality_score"))


def residuals(spark, sf, controls):
    return residual.residual_corr(residual.residual_scores(frames.hourly(spark, sf), TARGET, controls, MAX_LAG, PERIOD), MAX_LAG)


@query
def residual_corr(spark, sf):
    out = residuals(spark, sf, [CONTROL]).select("variable", "residual_status", "control_count", "control_matrix_rank", "residual_lag", "residual_corr", "residual_method", "residual_n", "residual_lag_quality", "condition_number")
    return r6(out, "residual_corr", "residual_lag_quality").withColumn("condition_number", F.round("condition_number", 4))


@query
def residual_corr_many_controls(spark, sf):
    return r6(residuals(spark, sf, [CONTROL, "signup"]).select("variable", "residual_status", "control_matrix_rank", "residual_lag", "residual_corr", "residual_n"), "residual_corr")


@query
def regime_scores(spark, sf):
    return r6(stability.regime_scores(frames.hourly(spark, sf), TARGET, CONTROL, MAX_LAG, PERIOD, rows=frames.hours(spark, sf)), "score", "signed_corr")


@query
def regime_robustness(spark, sf):
    out = stability.regime_robustness(stability.regime_scores(frames.hourly(spark, sf), TARGET, CONTROL, MAX_LAG, PERIOD, rows=frames.hours(spark, sf)), MAX_LAG)
    columns = ["regime_strength_consistency", "regime_sign_consistency", "regime_lag_consistency", "regime_stability_final"]
    return r6(out.select("variable", "regime_count", *columns, "regime_evidence_status", "regime_sign_reversal_flag"), *columns)


def rolling(spark, sf):
    best = association.best_lags(scores(spark, sf)).select("variable", "lag")
    pairs = axis.lagged_pairs(frames.hourly(spark, sf), TARGET, best, PERIOD).select("variable", "t", "x", "y")
    return stability.rolling_correlations(axis.segment_ids(pairs, PERIOD, keys=["variable"]), 24, 12)


@query
def rolling_corr(spark, sf):
    return r6(rolling(spark, sf), "r")


@query
def rolling_stability(spark, sf):
    out = stability.rolling_stability(rolling(spark, sf))
    return r6(out.select("variable", "rolling_corr_median", "rolling_sign_consistency", "valid_window_count", "rolling_stability"), "rolling_corr_median", "rolling_sign_consistency", "rolling_stability")


@query
def innovation(spark, sf):
    h, starts = frames.gapped(spark, sf)
    best = association.best_lags(association.lag_scores(h, TARGET, MAX_LAG, PERIOD, starts=starts, rows=frames.hours(spark, sf)))
    out = association.innovation(h, TARGET, best, MAX_LAG, PERIOD, ["exact"], starts)
    return r6(out.select("variable", "raw_lag", "innovation_lag", "innovation_score", "innovation_status"), "innovation_score")


@query
def lag_scores_with_gaps(spark, sf):
    h, starts = frames.gapped(spark, sf)
    return r6(association.lag_scores(h, TARGET, MAX_LAG, PERIOD, starts=starts, rows=frames.hours(spark, sf)).select("variable", "lag", "n", "pearson", "spearman"), "pearson", "spearman")


@query
def lag_scores_by_windows(spark, sf):
    """The way of series too long for a task."""
    pairs = axis.lagged_pairs(frames.hourly(spark, sf), TARGET, list(range(-MAX_LAG, MAX_LAG + 1)), PERIOD)
    return r6(association.pair_scores(pairs, ["variable", "lag"], MAX_LAG).select("variable", "lag", "n", "pearson", "spearman"), "pearson", "spearman")


@query
def lowpass_with_gaps(spark, sf):
    h, _ = frames.gapped(spark, sf)
    return r6(preprocess.lowpass(h, 90.0, ["tolerant"]).select("t", "variable", "value"), "value")


@query
def segments_with_gaps(spark, sf):
    return frames.gapped(spark, sf)[0].select("t", "exact", "tolerant").distinct()


@query
def resample_segments(spark, sf):
    h, _ = frames.gapped(spark, sf)
    out = axis.resample_segments(h.select("t", "variable", "value"), 10800, h.select("t", F.col("exact").alias("segment")).distinct())
    return r6(out, "value")


@query
def redundant_pairs(spark, sf):
    return r6(association.redundant_pairs(frames.hourly(spark, sf), TARGET), "r")


@query
def redundant_pairs_aligned(spark, sf):
    h = frames.hourly(spark, sf)
    lags = spark.createDataFrame([("click", 1), ("error", 2), ("signup", 2), ("view", -1)], "variable string, lag int")
    return r6(association.redundant_pairs(h, TARGET, lags, PERIOD, corr=0.01), "r")


@query
def redundant_variables(spark, sf):
    """Groups of parts that share a size; a part is redundant unless its evidence clearly exceeds that of all others of its group."""
    r = frames.rules(spark, sf)
    groups = r.select("variable", F.concat(F.lit("g"), F.expr("part div 3")).alias("group"))
    out = association.redundant_variables(groups, r, ["association_score", "lag_quality", "residual_corr"])
    return r.select("variable", "part").join(out, "variable").select("part", "redundant")


def scored(spark, sf):
    return ranking.score_components(frames.rules(spark, sf))


def used(spark, sf):
    return ranking.recommended_use(ranking.risk_flags(scored(spark, sf)))


@query
def score_components(spark, sf):
    columns = ["base_score", "support_bonus_rate", "stability_support", "evidence_score", "final_score"]
    return r6(scored(spark, sf).select("part", *columns), *columns)


@query
def risk_flags(spark, sf):
    return used(spark, sf).select("part", "risk_flags", "risk_count", "strong_risk_count", "risk_level")


@query
def grade_use(spark, sf):
    return used(spark, sf).select("part", "candidate_grade", "recommended_use")


@query
def risk_flag_filter(spark, sf):
    return filters.with_risk_flags(used(spark, sf), ["lag_boundary", "formula_like"]).select("part")


@query
def control_reference(spark, sf):
    return frames.rules(spark, sf).select("part", filters.control_reference(F.col("variable")).alias("reference"))


@query
def initial_order(spark, sf):
    return ranking.rank_rows(scored(spark, sf), ranking.initial_order(), "driver_rank").select("part", F.col("driver_rank").cast("long").alias("driver_rank"))


def pooled(spark, sf):
    u = used(spark, sf)
    res = u.select("variable", "residual_corr", "residual_lag_quality", F.col("residual_n"), "residual_status")
    return ranking.recommended_pool(u, res, 20, ["v3", "v31"]), res


@query
def recommended_pool(spark, sf):
    return pooled(spark, sf)[0].select("part", "candidate_source", "selected_by_raw", "selected_by_residual", "common_capacity_candidate_flag", F.col("candidate_pool_rank").cast("long").alias("candidate_pool_rank"))


@query
def priority_tiers(spark, sf):
    pool, res = pooled(spark, sf)
    out = ranking.priority_tiers(pool, res).select("part", "load_adjusted_relation_status", "candidate_priority_tier", "candidate_priority_score", F.col("candidate_priority_rank").cast("long").alias("candidate_priority_rank"))
    return r6(out, "candidate_priority_score")


@query
def review_tier(spark, sf):
    return review.review_candidates(used(spark, sf)).select("part", "review_priority")


@query
def review_decision(spark, sf):
    return used(spark, sf).select("part", review.review_decision().alias("decision"))


@query
def evidence_score(spark, sf):
    points = used(spark, sf).drop("evidence_score").withColumn("evidence_score", F.round(review.evidence_points(), 9))
    return points.select("part", F.round("evidence_score", 6).alias("points"), review.evidence_level().alias("evidence_level"))


@query
def evidence_matrix(spark, sf):
    """Tables that have rows of some variables only: those with a Granger q-value, those whose lift was computed."""
    r = frames.rules(spark, sf).select(F.col("part").cast("string").alias("variable"), "part", "lift_status", "granger_q")
    g = r.where("granger_q <= 0.1").select("variable", F.lit("supported").alias("state"))
    lift = r.where("lift_status = 'ok'").select("variable", F.col("lift_status").alias("state"))
    out = review.evidence_matrix(r, {"granger": g, "model": None, "lift": lift})
    return out.select(F.col("variable").cast("long").alias("part"), "granger", "model", "lift")


@query
def validation_summary(spark, sf):
    states = frames.rules(spark, sf).selectExpr(
        "part", "case part % 4 when 0 then 'supported' when 1 then 'zero' when 2 then 'missing' else 'not_run' end as a",
        "case part % 3 when 0 then 'supported' when 1 then 'no_support' else 'not_run' end as b", "case part % 2 when 0 then 'supported' else 'not_run' end as c",
    )
    status, consistency = review.validation_status(["a", "b", "c"])
    return states.select("part", status.alias("validation_status"), consistency.alias("evidence_consistency"))


@query
def final_review(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("part") % n + 1).cast("int"))
    d = scored(spark, sf).withColumns({"decision": pick(["priority_review", "secondary_review", "manual_review_only", "not_recommended", "other"], 5), "data_priority": pick(["high", "medium", "low"], 3)})
    return review.final_order(d).select("part", F.col("final_rank").cast("long").alias("final_rank"))


@query
def fill_missing_join(spark, sf):
    c = frames.read(spark, sf, "customer").selectExpr("c_custkey", "case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then null else c_mktsegment end as label")
    o = frames.read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return joins.fill_missing(c, o, "c_custkey", ["label"], "o_orderkey", blank=True)


def two_rankings(spark, sf):
    r = frames.rules(spark, sf)
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "part")).cast("long").alias("rank")
    return r, rank


@query
def branch_comparison(spark, sf):
    r, rank = two_rankings(spark, sf)
    # Every part is on one side at least: those with a raw score, those with a lag of some quality.
    a = r.where("raw_corr > 0 or lag_quality <= 0.1").select("variable", rank("raw_corr"), "lag", F.col("raw_corr").alias("score"))
    b = r.where("lag_quality > 0.1").select("variable", rank("lag_quality"), (-F.col("lag")).alias("lag"), F.col("lag_quality").alias("score"))
    out = joins.compare_branches(a, b, 20)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("lag_delta", "rank_delta")})
    return r6(out.select("variable", "presence", "score_delta", "lag_delta", "rank_delta", "direction_changed", "in_raw_top", "in_processed_top"), "score_delta")


@query
def occurrence_join(spark, sf):
    """The n-th line of a supplier that was sent on with its n-th that came back."""
    line = frames.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), (F.col("l_returnflag") == "N").alias("sent"))
    return joins.occurrence_join(line.where("sent").select("k", "i"), line.where("not sent").select("k", F.col("i").cast("double").alias("j")), "k", "i", "j")


@query
def topk_overlap(spark, sf):
    r, rank = two_rankings(spark, sf)
    return joins.topk_overlap(r.select("variable", rank("raw_corr")), r.select("variable", rank("lag_quality")), [10, 20, 30])


def splits(wide: DataFrame) -> list[validation.Split]:
    return validation.expanding_splits(wide.count(), gap=2)


@query
def expanding_splits(spark, sf):
    return validation.split_table(spark, splits(frames.hourly_wide(spark, sf)))


@query
def fold_context(spark, sf):
    wide = frames.hourly_wide(spark, sf).select("t")
    return r6(validation.fold_context(validation.fold_rows(wide, splits(wide))), "minutes")


FEATURES = [(TARGET, 1), ("click", 2), ("view", 5)]


@query
def lag_features(spark, sf):
    return r6(validation.lag_features(frames.hourly_wide(spark, sf), FEATURES, PERIOD), *[f"{v}__lag_{k}" for v, k in FEATURES])


@query
def fold_errors(spark, sf):
    pairs = validation.lag_features(frames.hourly_wide(spark, sf), [(TARGET, 1)], PERIOD).join(frames.hourly_wide(spark, sf).select("t", TARGET), "t")
    p = pairs.select(F.expr("cast(t div 604800 % 3 as int)").alias("fold"), F.col(TARGET).alias("actual"), F.col(f"{TARGET}__lag_1").alias("predicted")).dropna()
    return r6(validation.fold_errors(p, ["fold"]), "rmse", "mae", "r2")


@query
def uplift_summary(spark, sf):
    m = frames.read(spark, sf, "part").selectExpr("concat('v', p_partkey % 50) as variable", "(p_partkey * 7 % 41) / 2.0D - 8 as rmse_improvement_pct", "(p_partkey * 11 % 37) / 2.0D - 7 as mae_improvement_pct")
    columns = ["positive_rmse_fold_ratio", "median_rmse_improvement_pct", "median_mae_improvement_pct", "worst_fold_rmse_improvement_pct"]
    return r6(validation.uplift_summary(m).select("variable", "fold_count", "positive_rmse_fold_count", "positive_mae_fold_count", *columns, "validation_status"), *columns)


@query
def variable_importance(spark, sf):
    f = frames.read(spark, sf, "part").selectExpr("concat('v', p_partkey % 40, '__lag_', p_partkey) as feature", "(p_partkey * 13 % 1009) / 1009.0D as importance")
    return r6(validation.variable_importance(f).drop("best_feature"), "total_importance", "max_importance")


@query
def normal_curve(spark, sf):
    return r6(charts.normal_curve(frames.hourly(spark, sf)), "x", "y")


@query
def trend_stats(spark, sf):
    return r6(charts.trend_stats(frames.hourly(spark, sf)), "mean", "sd", "lo", "hi", "median", "span", "known_ratio")


@query
def histogram(spark, sf):
    return charts.histogram(frames.hourly(spark, sf))


@query
def downsample(spark, sf):
    return r6(axis.downsample(frames.hourly_wide(spark, sf).select("t", "purchase"), 100), "purchase")


@query
def scatter_matrix(spark, sf):
    return r6(charts.scatter_matrix(frames.hourly_wide(spark, sf), ["click"], ["purchase", "view"]), "x", "y")


@query
def lag_profile(spark, sf):
    return r6(charts.lag_profile(scores(spark, sf), "click"), "pearson", "spearman")


@query
def granger(spark, sf):
    return causality.granger(frames.hourly(spark, sf), TARGET, 3, PERIOD)


@query
def conditional_granger(spark, sf):
    return causality.conditional_granger(frames.hourly(spark, sf), TARGET, [CONTROL], 3, PERIOD)


@query
def model_lift(spark, sf):
    h = frames.hourly(spark, sf)
    return causality.model_lift(h, TARGET, association.best_lags(scores(spark, sf)), MAX_LAG, PERIOD)


@query
def forest_importance(spark, sf):
    wide = frames.hourly_wide(spark, sf)
    rows = validation.lag_features(wide, FEATURES, PERIOD).join(wide.select("t", TARGET), "t")
    return validation.forest_importance(rows, [f"{v}__lag_{k}" for v, k in FEATURES], TARGET)


@query
def boosted_folds(spark, sf):
    wide = frames.hourly_wide(spark, sf)
    rows = validation.lag_features(wide, FEATURES, PERIOD).join(wide.select("t", TARGET), "t").dropna()
    return validation.boosted_folds(rows, [f"{v}__lag_{k}" for v, k in FEATURES], TARGET, validation.expanding_splits(rows.count(), gap=2))


def screened(spark, sf):
    """A screen of the hourly frame without the excluded windows; rounded and not interpolated, as ranks of values a rounding apart would differ from machine to machine."""
    wide = stored(r6(frames.hourly_wide(spark, sf), *VARIABLES))
    config = Config(TARGET, MAX_LAG, controls=(CONTROL,), capacity=CONTROL, exclude_windows=tuple(frames.windows(wide)), interpolate_limit=0)
    return screen(wide, config), config


@query
def screening(spark, sf):
    s, _ = screened(spark, sf)
    return r6(s.ranked.select("driver_rank", "variable", "lag", "final_score", "candidate_grade", "recommended_use", "risk_flags"), "final_score")


@query
def review_queue(spark, sf):
    s, config = screened(spark, sf)
    return confirm(s, config)["review"].select("variable", "review_priority", "conditional_status", "conditional_q", "decision")


def ranked_rules(spark, sf):
    """The rule table as a ranking."""
    r = ranking.rank_rows(used(spark, sf), ranking.initial_order(), "driver_rank")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("part") % n + 1).cast("int"))
    return r.withColumns(
        {
            "method": pick(["pearson", "spearman"], 2), "pearson": F.col("lag_quality") - 0.5, "spearman": F.col("raw_corr") - 0.5, "direction": pick(["variable_leads", "target_leads"], 2),
            "final_recommendation": pick(["priority_review", "secondary_review", "risk_limited_review", "manual_review_only"], 4), "screening_lag": F.col("lag"),
            "candidate_class": pick(["upstream_driver", "downstream_response", "formula_or_derived"], 3), "final_rank": F.col("driver_rank"),
            "candidate_priority_rank": F.when(F.col("part") % 5 == 0, F.col("part") % 997), "candidate_pool_rank": F.when(F.col("part") % 3 == 0, F.col("part") % 991),
        }
    )


@query
def candidate_pool(spark, sf):
    out = stages.candidate_pool(ranked_rules(spark, sf), "v7", top_n=6, forced=["v2", "v7", "v30", "absent"], controls=["v5"])
    return out.select("variable", "candidate_order", "selection_source", "force_included", "auto_eligible", "auto_exclusion_reasons")


@query
def candidate_exclusions(spark, sf):
    return ranked_rules(spark, sf).select("part", stages.exclusion_reasons("v7", ["v5"]).alias("reasons"))


@query
def review_pool(spark, sf):
    return stages.review_pool(ranked_rules(spark, sf), 12, ["v4", "v6", "absent"]).select("variable", "candidate_source", "source_rank", "pool_order")


@query
def secondary_variables(spark, sf):
    return stages.secondary_variables(ranked_rules(spark, sf), 15, ["v4", "v9"], ["v4", "other"])


def feature_importance(spark, sf):
    return frames.read(spark, sf, "part").selectExpr("concat('v', p_partkey % 40, '__lag_', p_partkey % 13) as feature", "(p_partkey * 13 % 1009) / 1009.0D as importance").groupBy("feature").agg(F.max("importance").alias("importance"))


@query
def discovered_candidates(spark, sf):
    out = stages.discovered(feature_importance(spark, sf), ranked_rules(spark, sf), max_lag=12)
    return r6(out.select("variable", "best_model_feature", "best_model_lag", "max_importance", "importance_rank", "model_feature_count", "nearby_lag_count", "in_screening_top_n", "discovery_reason"), "max_importance")


@query
def discovery_candidates(spark, sf):
    r = ranked_rules(spark, sf)
    return stages.discovery_candidates(r.select("variable", F.concat(F.lit("model:"), "risk_level").alias("discovery_reason")), r, 20)


@query
def ranked_lag_merge(spark, sf):
    r = ranked_rules(spark, sf).select("variable", "driver_rank", "part", "lag", "final_score", "risk_level")
    selected = r.select("variable", F.lit(99).alias("lag"), F.expr("case when part % 2 = 0 then final_score * 2 end").alias("final_score"), F.lit("kept").alias("note"))
    return r6(stages.with_ranked(selected, r, prefer_ranked_lag=True).select("part", "lag", "final_score", "note", "risk_level"), "final_score")


def stage_tables(spark, sf):
    r = ranked_rules(spark, sf)
    lift = r.where("lift_status = 'ok'").select("variable", F.col("lift_status").alias("status"), "model_lift", F.col("raw_corr").alias("ar_baseline_rmse"), F.col("lag_quality").alias("candidate_rmse"))
    rolling = r.where("rolling_stability is not null").select("variable", "rolling_stability", F.col("raw_corr").alias("rolling_corr_median"), "rolling_sign_consistency", F.lit(7).alias("valid_window_count"), (F.col("lag") + 1).alias("best_lag"))
    return r, lift, rolling


@query
def enhanced_summary(spark, sf):
    r, lift, rolling = stage_tables(spark, sf)
    return r6(stages.enhanced_summary(r.where("final_score > 0.2"), lift, rolling), "final_score", "model_lift", "ar_baseline_rmse", "candidate_rmse", "rolling_stability", "rolling_corr_median", "rolling_sign_consistency")


@query
def validation_fields(spark, sf):
    r, lift, rolling = stage_tables(spark, sf)
    granger = r.where("granger_q <= 0.1").select("variable", (F.col("lag") - 2).alias("best_lag"))
    conditional = r.where("conditional_status = 'ok'").select("variable", F.col("lag").alias("best_lag"))
    return r6(stages.validation_fields(r, r.where("model_lift > 0.05"), lift, rolling, granger, conditional), "screening_model_lift", "validation_model_lift")


def fold_table(spark, sf):
    return frames.read(spark, sf, "part").selectExpr("cast(p_partkey % 3 as int) as fold", "element_at(array('M0', 'M1', 'M2'), cast(p_partkey div 3 % 3 + 1 as int)) as model", "1 + p_partkey % 17 / 8.0D as rmse", "p_partkey % 13 / 7.0D as mae", "p_partkey % 11 / 11.0D as r2")


@query
def model_summary(spark, sf):
    columns = ["mean_rmse", "median_rmse", "mean_mae", "median_mae", "mean_r2", "m2_vs_m1_rmse_improvement_pct", "m2_vs_m1_mae_improvement_pct"]
    return r6(stages.model_summary(fold_table(spark, sf)).select("model", "fold_count", *columns), *columns)


@query
def candidate_uplift(spark, sf):
    f = fold_table(spark, sf).groupBy("fold", "model").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    c = frames.read(spark, sf, "part").selectExpr("concat('v', p_partkey) as variable", "cast(p_partkey % 3 as int) as fold", "1 + p_partkey % 19 / 9.0D as rmse", "p_partkey % 23 / 11.0D as mae")
    return r6(stages.candidate_uplift(c, f.where("model = 'M1'")).select("variable", "fold", "rmse_improvement_pct", "mae_improvement_pct"), "rmse_improvement_pct", "mae_improvement_pct")


@query
def display_fields(spark, sf):
    return r6(stages.with_display_fields(ranked_rules(spark, sf)).select("part", "dominant_corr", "correlation_direction"), "dominant_corr")


@query
def control_roles(spark, sf):
    """Parts as points of loops: every loop has some of .PV, .SV and .MV."""
    r = used(spark, sf)
    point = F.expr("concat(element_at(array('FIC', 'TIC', 'XY', 'AI', 'PUMP', 'feed'), cast(part % 6 + 1 as int)), cast(part div 7 as varchar(20)), element_at(array('.PV', '.SV', '.MV', '', '.op', '.PV', ''), cast(part % 7 + 1 as int)))")
    out = stages.control_role(r.select("part", point.alias("variable"), "risk_flags"))
    return out.select("part", "loop_tag", "related_sv", "related_mv", "suggested_control_role").distinct()


@query
def overview(spark, sf):
    r = ranked_rules(spark, sf)
    return stages.overview(r, r.where("driver_rank <= 25"))


@query
def trend_bounds(spark, sf):
    return stages.trend_bounds(frames.hourly_wide(spark, sf).select("t"), 100)


@query
def expectation_errors(spark, sf):
    e = frames.read(spark, sf, "part").selectExpr("case when p_partkey % 50 = 0 then ' ' else concat('v', p_partkey % 1999) end as variable", "element_at(array('reasonable_driver', 'implausible_driver', 'neutral', 'else'), cast(p_partkey % 4 + 1 as int)) as expected_class")
    return stages.expectation_errors(e)


@query
def baseline_metrics(spark, sf):
    r = ranked_rules(spark, sf)
    expected = r.where("part % 7 < 3").selectExpr("variable", "element_at(array('reasonable_driver', 'implausible_driver', 'neutral'), cast(part % 7 + 1 as int)) as expected_class")
    columns = ["recall_of_expected", "recall_of_found", "implausible_share"]
    return r6(stages.baseline_metrics(r, expected, [10, 20]), *columns)


@query
def first_step(spark, sf):
    return axis.first_step(frames.gapped(spark, sf)[0].select("t"))


@query
def granger_order(spark, sf):
    r = frames.rules(spark, sf).select("part", "variable", "lag", F.expr("case when part % 9 = 0 then null else granger_q end").alias("q"))
    return stages.granger_order(r).select("part", F.col("q_order").cast("long").alias("q_order"))


@query
def causal_frame(spark, sf):
    h, _ = frames.gapped(spark, sf)
    return r6(preprocess.causal_frame(h, TARGET, 2, ["exact"]).select("t", "variable", "value"), "value")


@query
def review_assessments(spark, sf):
    r = used(spark, sf).withColumn("conditional_status", F.expr("case when part % 10 = 0 then '' when part % 10 = 5 then 'ok_fallback_missing_ranked_lag' when part % 10 = 7 then 'fit_failed' else conditional_status end"))
    out = review.assessments(r)
    return out.select("part", "independent_predictive_support", "confounder_assessment", "control_relation_assessment", "statistical_limitation", "direction_assessment")


@query
def review_conflicts(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("part") % n + 1).cast("int"))
    r = used(spark, sf).withColumns({"data_priority": pick(["high", "medium"], 2), "statistical_limit_level": pick(["none", "medium", "strong"], 3)})
    return review.conflicts(r).select("part", "conflict_types", "lag_boundary_hint")


@query
def review_rollup(spark, sf):
    p = frames.read(spark, sf, "part")
    folds = p.selectExpr("concat('v', p_partkey % 50) as variable", "p_partkey % 3 as fold", "case when p_partkey % 11 = 0 then null else p_partkey * 60 end as test_start", "p_partkey * 60 + 30 as test_end")
    context = p.selectExpr("p_partkey as fold", "15 as sampling_minutes", "p_partkey % 2 as max_used_lag", "case when p_partkey % 2 = 0 then 5 end as partly")
    return stages.review_rollup(p.selectExpr("concat('v', p_partkey % 60) as variable").distinct(), folds, context)


def validation_run(spark, sf, mode="raw"):
    pool = spark.createDataFrame([(1, "click", 2), (2, "error", 3), (3, "signup", -1)], "candidate_order int, variable string, screening_lag int")
    return validate(frames.hourly_wide(spark, sf), TARGET, pool, [CONTROL], MAX_LAG, mode=mode)


@query
def model_validation(spark, sf):
    """M0, M1, M2 and a model a candidate on three folds: the candidates' verdicts."""
    return validation_run(spark, sf).uplift


@query
def model_validation_folds(spark, sf):
    return validation_run(spark, sf, "lowpass").fold_metrics


@query
def fold_features(spark, sf):
    """The rows that the models of the last fold see."""
    rows = validation_run(spark, sf).rows
    return r6(rows.where("fold = 2").select("part", "t", "y", F.col("purchase__lag_1").alias("y_1"), F.col("view__lag_5").alias("view_5"), F.col("click__lag_4").alias("click_4")), "y", "y_1", "view_5", "click_4")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_lag(spark, sf_dir).orderBy(F.desc("score")).limit(20)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
