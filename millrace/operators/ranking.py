"""Scores, risk flags, grades, uses, the recommended pool and its priorities: row functions and ordered ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    GRADES, REGIME_UNSTABLE, REGIME_WEIGHT_LAG, REGIME_WEIGHT_STRENGTH, RESIDUAL_BONUS, RESIDUAL_MIN_CORR, RESIDUAL_MIN_N, RAW_MIN_SCORE,
    ROLLING_UNSTABLE, STABILITY_BONUS, STRONG_RISKS, TARGET_LEADS_CAP, TARGET_LEADS_RATE, TOTAL_BONUS_CAP,
)
from ..functions.mathx import clip
from . import filters, quality


def rolling_support() -> Column:
    return clip(F.col("rolling_sign_consistency") * (1 - F.least(F.lit(1.0), F.col("rolling_corr_iqr"))))


def regime_support() -> Column:
    shape = REGIME_WEIGHT_STRENGTH * F.col("regime_strength_consistency") + REGIME_WEIGHT_LAG * F.col("regime_lag_consistency")
    return F.when(F.col("regime_evidence_status").isin("ok", "full_coverage", "partial_coverage"), clip(F.col("regime_coverage") * F.col("regime_sign_consistency") * shape))


def score_components(df: DataFrame) -> DataFrame:
    """Adds the score's parts from association_score, data_quality_score and the support columns; absent support adds nothing."""
    base = clip("association_score") * clip("data_quality_score")
    known = lambda c: c.isNotNull()
    df = df.withColumns({"base_score": F.when(known(F.col("association_score")) & known(F.col("data_quality_score")), base), "residual_support": F.when((F.col("residual_status") == "ok") & known(F.col("residual_corr")), clip("residual_corr"))})
    rolling = F.when(known(F.col("rolling_sign_consistency")) & known(F.col("rolling_corr_iqr")), rolling_support())
    complete = known(F.col("regime_coverage")) & known(F.col("regime_sign_consistency")) & known(F.col("regime_strength_consistency")) & known(F.col("regime_lag_consistency"))
    df = df.withColumns({"rolling_support": rolling, "regime_support": F.when(complete, regime_support())})
    both = F.sqrt(F.col("rolling_support") * F.col("regime_support"))
    df = df.withColumn("stability_support", F.coalesce(both, "rolling_support", "regime_support"))
    bonus = RESIDUAL_BONUS * F.coalesce("residual_support", F.lit(0.0)) + STABILITY_BONUS * F.coalesce("stability_support", F.lit(0.0))
    df = df.withColumn("support_bonus_rate", clip(bonus, 0.0, TOTAL_BONUS_CAP))
    df = df.withColumn("evidence_score", F.when(known(F.col("base_score")), F.least(F.lit(1.0), F.col("base_score") * (1 + F.col("support_bonus_rate")))))
    capped = F.least(F.col("evidence_score") * TARGET_LEADS_RATE, F.lit(TARGET_LEADS_CAP))
    leads = F.coalesce(F.col("temporal_direction_status") == "target_leads_supported", F.lit(False))
    return df.withColumn("final_score", F.when(known(F.col("evidence_score")), F.when(leads, capped).otherwise(F.col("evidence_score"))))


def flag_conditions(has_controls: bool) -> dict[str, Column]:
    """Every risk flag's condition, in the order in which flags are listed."""
    raw = F.coalesce("raw_corr", F.lit(0.0))
    lag = F.coalesce("lag", F.lit(0))
    formula = filters.formula_like(F.col("variable"))
    ok_residual = F.coalesce("residual_status", F.lit("ok"))
    residual = F.coalesce("residual_corr", raw)
    lift_ok = F.coalesce(F.col("lift_status").startswith("ok"), F.lit(False))
    lift = F.coalesce("model_lift", F.lit(0.0))
    regime_seen = F.coalesce(F.col("regime_evidence_status").isin("partial_coverage", "full_coverage"), F.lit(False))
    return {
        "formula_like": formula,
        "strong_formula_leakage": formula & (raw > 0.98) & (lag == 0),
        "common_capacity_driver": F.lit(has_controls) & (ok_residual == "ok") & (raw >= 0.5) & (residual < raw * 0.65),
        "redundant_proxy": F.coalesce("redundant", F.lit(False)),
        "target_leads_variable": F.coalesce(F.col("temporal_direction_status") == "target_leads_supported", F.lit(False)),
        "unstable_across_regimes": regime_seen & F.coalesce(F.col("regime_stability_final") < REGIME_UNSTABLE, F.lit(False)),
        "unstable_over_time": (F.coalesce("rolling_stability", F.lit(1.0)) < ROLLING_UNSTABLE) & ~(lift_ok & (lift >= 0.05) & (raw < 0.2)),
        "lag_boundary": F.coalesce("lag_boundary_flag", F.lit(False)),
        "low_model_lift": lift_ok & (lift < 0.01),
        "poor_data_quality": quality.poor() & ~quality.severe(),
        "severe_data_quality": quality.severe(),
        "residual_collinearity": ok_residual.isin("ok", "rank_deficient") & (F.coalesce("condition_number", F.lit(0.0)) > 1e8),
    }


def risk_flags(df: DataFrame, has_controls: bool = True) -> DataFrame:
    """Adds flags (array), risk_flags, counts and risk_level."""
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flag_conditions(has_controls).items()]))
    df = df.withColumn("flags", flags)
    strong = F.size(F.array_intersect("flags", F.array(*[F.lit(s) for s in STRONG_RISKS])))
    df = df.withColumns({"risk_flags": F.array_join("flags", ";"), "risk_count": F.size("flags"), "strong_risk_count": strong})
    df = df.withColumn("weak_risk_count", F.col("risk_count") - F.col("strong_risk_count"))
    level = F.when(F.col("risk_count") == 0, "none").when(F.col("strong_risk_count") >= 2, "strong").when(F.col("strong_risk_count") == 1, "medium").otherwise("weak")
    return df.withColumn("risk_level", level)


def grade(score: Column) -> Column:
    out = F.lit("E")
    for g, least in reversed(GRADES):
        out = F.when(score >= least, g).otherwise(out)
    return F.when(score.isNull(), "E").otherwise(out)


def recommended_use(df: DataFrame) -> DataFrame:
    """Adds candidate_grade and recommended_use, by the first rule that holds."""
    df = df.withColumn("candidate_grade", grade(F.col("final_score")))
    has = lambda f: F.array_contains("flags", f)
    formula = has("strong_formula_leakage") | (has("formula_like") & has("common_capacity_driver")) | (has("formula_like") & (F.coalesce("lag", F.lit(0)) == 0) & (F.coalesce("raw_corr", F.lit(0.0)) >= 0.95))
    use = (
        F.when(has("severe_data_quality"), "poor_quality_variable").when(formula, "formula_coupled_reference")
        .when(F.col("temporal_direction_status") == "target_leads_supported", "state_indicator")
        .when(has("common_capacity_driver"), "capacity_driven").when(has("unstable_across_regimes") | has("unstable_over_time"), "unstable_candidate")
        .when(F.col("candidate_grade") == "A", "strong_screening_candidate").otherwise("manual_review_required")
    )
    return df.withColumn("recommended_use", use)


def initial_order() -> list[Column]:
    return [F.desc_nulls_last("final_score"), F.desc_nulls_last("association_score"), F.desc_nulls_last("lag_quality"), F.asc("variable")]


def rank_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Numbers rows from 1; tables here have a row a variable."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def recommended_pool(ranked: DataFrame, residual: DataFrame, top_k: int, forced: list[str] = ()) -> DataFrame:
    """Union of the best by final score, the best by residual correlation and forced variables, with source and rank."""
    force_place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in forced]), F.col("variable")), F.lit(0)) if forced else F.lit(0)
    r = residual.select("variable", F.col("residual_corr").alias("_c"), F.col("residual_lag_quality").alias("_q"), F.col("residual_n").alias("_n"), F.col("residual_status").alias("_s"))
    eligible = ~F.coalesce("is_control_reference", F.lit(False))
    usable = eligible & F.col("_s").isin("ok", "rank_deficient") & (F.col("_n") > 0) & F.col("_c").isNotNull()
    strong = (F.col("_c") >= RESIDUAL_MIN_CORR) & (F.col("_n") >= RESIDUAL_MIN_N) & F.col("_q").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    pool = ranked.join(r, "variable", "left").withColumns({"_raw": yes(eligible & (F.col("final_score") >= RAW_MIN_SCORE)), "_usable": yes(usable), "_strong": yes(usable & strong)})
    # Ranks among the rows that qualify: one window for each channel, no joins.
    order = [F.desc("_c"), F.desc_nulls_last("_q"), F.desc("_n"), F.asc(F.when(F.col("_s") == "ok", 0).otherwise(1)), F.asc("variable")]
    place = lambda who, by: F.when(F.col(who), F.row_number().over(Window.partitionBy(who).orderBy(*by)))
    pool = pool.withColumns({"raw_candidate_rank": place("_raw", initial_order()), "residual_candidate_rank": place("_strong", order), "_res": F.when(F.col("_usable"), F.col("_c"))})
    pool = pool.withColumns({c: F.when(F.col(c) <= top_k, F.col(c)) for c in ("raw_candidate_rank", "residual_candidate_rank")})
    pool = pool.withColumns({"selected_by_raw": F.col("raw_candidate_rank").isNotNull(), "selected_by_residual": F.col("residual_candidate_rank").isNotNull(), "force_included": force_place > 0, "_force": force_place})
    pool = pool.where("selected_by_raw or selected_by_residual or force_included")
    source = (
        F.when(F.coalesce("is_control_reference", F.lit(False)), "control_reference").when(F.col("selected_by_raw") & F.col("selected_by_residual"), "raw_and_residual")
        .when(F.col("selected_by_raw"), "raw_only").when(F.col("selected_by_residual"), "residual_only").otherwise("force_included")
    )
    common = F.col("selected_by_raw") & ~F.col("selected_by_residual") & (F.col("raw_corr") >= 0.5) & (F.col("_res") < F.col("raw_corr") * 0.65)
    pool = pool.withColumns({"candidate_source": source, "common_capacity_candidate_flag": F.coalesce(common, F.lit(False))})
    place = F.when(F.col("candidate_source") == "raw_and_residual", 0).when(F.col("candidate_source").isin("raw_only", "residual_only"), 1).when(F.col("candidate_source") == "force_included", 2).otherwise(3)
    ranks = [F.asc(place), F.asc_nulls_last(F.least("raw_candidate_rank", "residual_candidate_rank")), F.asc_nulls_last("raw_candidate_rank"), F.asc_nulls_last("residual_candidate_rank"), F.asc_nulls_last(F.when(F.col("_force") > 0, F.col("_force"))), F.asc("variable")]
    return rank_rows(pool, ranks, "candidate_pool_rank").drop("_res", "_force", "_c", "_q", "_n", "_s", "_raw", "_usable", "_strong")


def priority_tiers(pool: DataFrame, residual: DataFrame) -> DataFrame:
    """Adds residual_signal_score, load_adjusted_relation_status, candidate_priority_tier, _score and _rank."""
    r = residual.select("variable", F.col("residual_corr").alias("_c"), F.col("residual_lag_quality").alias("_q"), F.col("residual_n").alias("_n"), F.col("residual_status").alias("_s"))
    df = pool.join(r, "variable", "left")
    complete = F.coalesce(F.col("_s").isin("ok", "rank_deficient") & F.col("_c").isNotNull() & F.col("_q").isNotNull() & F.col("_n").isNotNull(), F.lit(False))
    strong = complete & (F.col("_c") >= RESIDUAL_MIN_CORR) & (F.col("_n") >= RESIDUAL_MIN_N)
    control = F.col("candidate_source") == "control_reference"
    df = df.withColumn("residual_signal_score", F.when(complete, (clip("_c") + clip("_q")) / 2))
    df = df.withColumn("residual_evidence_status", F.when(control, "control_reference").when(F.col("_s").isNull(), "missing").when(~complete, "insufficient").when(strong, "strong").otherwise("weak"))
    raw, res = F.col("selected_by_raw"), F.col("selected_by_residual")
    only = raw & ~res
    status = (
        F.when(control, "control_reference").when(raw & res, "dual_channel_supported").when(~raw & res, "residual_only_supported")
        .when(only & F.col("common_capacity_candidate_flag"), "raw_only_common_load_risk").when(only & (F.col("residual_evidence_status") == "weak"), "raw_only_residual_weak")
        .when(only & F.col("residual_evidence_status").isin("missing", "insufficient"), "raw_only_residual_missing").when(only, "raw_only_supported").otherwise("force_included_only")
    )
    df = df.withColumn("load_adjusted_relation_status", status)
    score = F.when(raw & res, 0.6 * F.col("final_score") + 0.4 * F.col("residual_signal_score")).when(only, F.col("final_score")).when(~raw & res, F.col("residual_signal_score"))
    s = F.col("load_adjusted_relation_status")
    tier = F.when(s == "dual_channel_supported", 0).when(s.isin("raw_only_supported", "residual_only_supported", "raw_only_residual_weak", "raw_only_residual_missing"), 1).when(s == "raw_only_common_load_risk", 2).when(s == "force_included_only", 3).otherwise(4)
    df = df.withColumns({"candidate_priority_score": score, "candidate_priority_tier": tier})
    order = [F.asc("candidate_priority_tier"), F.desc_nulls_last("candidate_priority_score"), F.desc_nulls_last("_n"), F.asc("candidate_pool_rank"), F.asc("variable")]
    return rank_rows(df, order, "candidate_priority_rank").drop("_c", "_q", "_n", "_s")
