"""Review rules after screening: candidates, decisions, evidence and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENCE_USES = ("capacity_driven", "formula_coupled_reference", "unstable_candidate", "control_variable_reference")
LIMITING_FLAGS = "common_capacity_driver|unstable_candidate|unstable_across_regimes|unstable_over_time"


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def review_tier() -> Column:
    risk, grade, use = text("risk_level"), text("candidate_grade"), text("recommended_use")
    return (
        F.when(use.isin(*REFERENCE_USES), 4)
        .when((grade == "A") & use.isin("strong_screening_candidate", "prediction_candidate") & risk.isin("none", "weak", ""), 1)
        .when(grade.isin("A", "B") & risk.isin("none", "weak", "medium", ""), 2)
        .when(F.coalesce("final_score", F.lit(0.0)) >= 0.45, 3).otherwise(5)
    )


def review_candidates(pool: DataFrame) -> DataFrame:
    return pool.withColumn("review_priority", review_tier()).withColumn("review_tier", F.concat(F.lit("tier_"), F.col("review_priority")))


def risk_limited() -> Column:
    return F.lower(text("risk_flags")).rlike(LIMITING_FLAGS) | F.lower(text("recommended_use")).isin("capacity_driven", "unstable_candidate")


def review_decision() -> Column:
    """From conditional status, q-value, contribution and risk, by the first rule that holds."""
    status = text("conditional_status")
    q, c = F.col("conditional_q"), F.col("predictive_contribution")
    ok = status.startswith("ok")
    at = lambda most, least: F.coalesce((q <= most) & (c >= least), F.lit(False))
    return (
        F.when((status == "high_collinearity_risk") & F.coalesce(c > 0, F.lit(False)), "manual_review_only").when(risk_limited() & ~ok, "risk_limited_review")
        .when(~ok, "insufficient_evidence").when(F.lower(text("risk_level")).isin("high", "strong"), "manual_review_only").when(risk_limited(), "risk_limited_review")
        .when(at(0.05, 0.05), "priority_review").when(at(0.1, 0.02), "secondary_review").otherwise("not_recommended")
    )


def evidence_points() -> Column:
    """Additive evidence: grade, conditional tests, lift, rolling stability, signs and importance."""
    case = lambda c, *steps: F.coalesce(_ladder(c, steps), F.lit(0.0))
    g = text("candidate_grade")
    grade = F.when(g == "A", 2.0).when(g == "B", 1.5).when(g == "C", 1.0).when(g == "D", 0.5).otherwise(0.0)
    ok = text("conditional_status").startswith("ok")
    fallback = text("conditional_status").contains("fallback")
    q = F.when(ok, F.when(fallback, F.when(F.col("conditional_q") <= 0.10, 0.4)).when(F.col("conditional_q") <= 0.05, 2.0).when(F.col("conditional_q") <= 0.10, 1.0))
    contribution = F.when(F.col("predictive_contribution") > 0, F.when(text("conditional_status") == "high_collinearity_risk", 0.3).otherwise(0.5))
    granger = F.when(F.col("granger_q") <= 0.05, 0.75).when(F.col("granger_q") <= 0.10, 0.4)
    rank = F.when(F.col("importance_rank") <= 5, 0.75).when(F.col("importance_rank") <= 10, 0.4)
    parts = [F.coalesce(x, F.lit(0.0)) for x in (q, contribution, granger, rank)]
    return grade + parts[0] + parts[1] + parts[2] + case("model_lift", (0.05, 0.75), (0.01, 0.4)) + case("rolling_stability", (0.7, 0.75), (0.5, 0.4)) + case("sign_consistency", (0.8, 0.3)) + parts[3]


def _ladder(c: str, steps: tuple) -> Column:
    out = F.lit(0.0)
    for least, points in reversed(steps):
        out = F.when(F.col(c) >= least, points).otherwise(out)
    return out


def evidence_level() -> Column:
    s = F.col("evidence_score")
    return (
        F.when(text("risk_level") == "strong", "risk_limited").when((s >= 4) & text("risk_level").isin("", "none", "weak"), "strong").when(s >= 2.5, "moderate")
        .when(s >= 1, "weak_or_incomplete").when(text("conditional_status").rlike("insufficient|skipped|^$"), "insufficient").otherwise("not_supported")
    )


def evidence_matrix(ranked: DataFrame, tables: dict[str, DataFrame | None]) -> DataFrame:
    """One state a method and variable: not_computed (the method did not run), missing (no row), else its state."""
    out = ranked.select("variable")
    for name, t in tables.items():
        if t is None:
            out = out.withColumn(name, F.lit("not_computed"))
        else:
            one = t.groupBy("variable").agg(F.min("state").alias(f"_{name}"))
            out = out.join(one, "variable", "left").withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit("missing"))).drop(f"_{name}")
    return out


def validation_status(methods: list[str]) -> tuple[Column, Column]:
    """(status, consistency) from state columns: supported, zero, no_support, missing or not_run."""
    of = lambda *s: sum((F.col(m).isin(*s).cast("int") for m in methods), F.lit(0))
    ran, support, weak, limit = of("supported", "zero", "no_support", "missing"), of("supported"), of("zero", "no_support"), of("zero", "no_support", "missing")
    status = F.when(ran == 0, "not_run").when(support == 0, F.when(weak > 0, "limited").otherwise("not_computed")).when(limit > 0, "limited").when(support >= 2, "supported").otherwise("limited")
    consistency = F.when(status == "supported", "consistent").when(status == "limited", "partial").otherwise(status)
    return status, consistency


DECISIONS = ["priority_review", "priority_review_with_limit", "secondary_review", "secondary_review_with_limit", "manual_review_only", "risk_limited_review", "insufficient_evidence", "not_recommended"]


def final_order(df: DataFrame) -> DataFrame:
    """Ranks by decision, data priority, evidence and screening score; equal rows by variable."""
    place = F.array_position(F.array(*[F.lit(d) for d in DECISIONS]), F.col("decision"))
    priority = F.when(F.col("data_priority") == "high", 0).when(F.col("data_priority") == "medium", 1).otherwise(2)
    w = Window.orderBy(F.when(place == 0, 99).otherwise(place), priority, F.desc_nulls_last("evidence_score"), F.desc_nulls_last("final_score"), "variable")
    return df.withColumn("final_rank", F.row_number().over(w))


def insufficient(status: Column) -> Column:
    """Whether a test's status says that it gave no result; no status counts so."""
    return (status == "") | status.rlike("insufficient|missing|not_found|not enough|skipped|failed|error|empty")


def assessments(df: DataFrame) -> DataFrame:
    """Adds five readings of a reviewed variable's evidence; they change no score and no decision.

    Reads conditional_status, conditional_q, predictive_contribution, risk_flags, recommended_use, lag, temporal_direction_status,
    is_control_reference and condition_number, and where df has them load_adjusted_relation_status, residual_evidence_status and common_capacity_candidate_flag.
    """
    has = lambda c: c in df.columns
    status, use = F.lower(text("conditional_status")), F.lower(text("recommended_use"))
    flags = F.split(F.lower(text("risk_flags")), ";")
    flagged = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    relation = F.lower(text("load_adjusted_relation_status")) if has("load_adjusted_relation_status") else F.lit("")
    residual = F.lower(text("residual_evidence_status")) if has("residual_evidence_status") else F.lit("")
    common = F.coalesce("common_capacity_candidate_flag", F.lit(False)) if has("common_capacity_candidate_flag") else F.lit(False)
    gains = F.coalesce(F.col("predictive_contribution") > 0, F.lit(False))
    q, lag = F.col("conditional_q"), F.col("lag")
    small = F.coalesce(q <= 0.10, F.lit(False))
    not_run = status.isin("", "not_computed", "not_run", "not_available")
    fallback = status.contains("fallback_missing_ranked_lag")
    limited = lambda c: F.when(c, "supported_with_limitations").otherwise("not_supported")
    support = (
        F.when(not_run, "not_computed").when(status == "high_collinearity_risk", limited(gains)).when(fallback, limited(gains & (q.isNull() | small)))
        .when(insufficient(status), "not_computed").when(status.startswith("ok"), F.when(small & gains, "supported").otherwise("not_supported")).otherwise("not_computed")
    )
    confounder = (
        F.when(flagged("formula_like", "strong_formula_leakage") | (use == "formula_coupled_reference"), "formula_relation_risk")
        .when(flagged("common_capacity_driver") | (use == "capacity_driven") | (relation == "raw_only_common_load_risk") | common, "common_driver_risk")
        .when(flagged("residual_collinearity", "redundant_proxy") | (relation == "raw_only_residual_weak") | (residual == "weak"), "shared_signal_risk")
        .when(F.col("risk_flags").isNull() & F.col("recommended_use").isNull(), "not_assessed").otherwise("no_flagged_confounder")
    )
    control = (
        F.when((use == "control_variable_reference") | F.coalesce("is_control_reference", F.lit(False)), "control_reference")
        .when(flagged("target_leads_variable") | F.coalesce(F.col("temporal_direction_status") == "target_leads_supported", F.lit(False)) | F.coalesce(lag < 0, F.lit(False)) | (use == "state_indicator"), "possible_control_response")
        .when(flagged("common_capacity_driver") | (use == "capacity_driven"), "shared_capacity_or_control_context")
        .when(F.col("risk_flags").isNull() & F.col("recommended_use").isNull() & F.col("temporal_direction_status").isNull(), "not_assessed").otherwise("no_control_relation_flagged")
    )
    limitation = (
        F.when(status.contains("high_collinearity_risk") | flagged("high_collinearity_risk", "residual_collinearity") | F.coalesce(F.col("condition_number") > 1e8, F.lit(False)), "high_collinearity_limitation")
        .when(status.rlike("insufficient|not enough"), "insufficient_sample_limitation").when(not_run, "not_computed").when(status.rlike("failed|error"), "failed_statistical_limitation")
        .when(fallback, "no_flagged_statistical_limitation").when(insufficient(status), "not_computed").otherwise("no_flagged_statistical_limitation")
    )
    direction = F.when(lag.isNull(), "not_computed").when(lag > 0, "variable_leads_target").when(lag < 0, "target_leads_variable").otherwise("zero_lag")
    return df.withColumns(
        {
            "independent_predictive_support": support, "confounder_assessment": confounder, "control_relation_assessment": control, "statistical_limitation": limitation, "direction_assessment": direction,
        }
    )


def conflicts(df: DataFrame) -> DataFrame:
    """Adds conflict_types (joined by ;) and lag_boundary_hint: where screening, conditional tests and models disagree.

    Reads data_priority, statistical_limit_level, candidate_grade, conditional_status, conditional_q, importance_rank and risk_flags.
    """
    grade, flags = F.upper(text("candidate_grade")), F.lower(text("risk_flags"))
    supported = F.lower(text("conditional_status")).startswith("ok") & F.coalesce(F.col("conditional_q") <= 0.05, F.lit(False))
    leading = F.coalesce(F.col("importance_rank") <= 5, F.lit(False))
    boundary = flags.rlike("lag_boundary|滞后边界")
    found = F.array(
        F.when((F.lower(text("data_priority")) == "high") & F.lower(text("statistical_limit_level")).isin("medium", "strong"), "strong_screening_but_statistical_limited"),
        F.when(grade.isin("A", "B") & ~supported, "strong_screening_but_conditional_weak"),
        F.when(supported & grade.isin("D", "E"), "conditional_supported_but_screening_weak"),
        F.when(leading & (~supported | flags.contains("high_collinearity_risk")), "model_supported_but_granger_weak"),
        F.when(boundary, "boundary_lag_uncertain"),
    )
    return df.withColumns({"conflict_types": F.array_join(F.array_compact(found), ";"), "lag_boundary_hint": F.when(boundary, "scan_further").otherwise("")})
