"""Runs in a result folder: both screening branches, the confirmed one, and the later stages on it.

The raw and the processed branch (`Config.mode`) are screened and published side by side; the
confirmed one is the formal result that later stages read. No stage writes back to it.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causality, joins, ranking, review, stages, validation
from ..operators.preprocess import Frame
from ..sources import outputs
from ..sources.staging import forget, stored
from . import validation as out_of_time
from .screening import Config, Screening, prepared, retained, screen

BRANCHES = ("raw", "processed")


def branch_tables(s: Screening, config: Config) -> dict[str, DataFrame]:
    pool = ranking.priority_tiers(s.pool, s.residual)
    return {
        "ranked_features": stages.with_display_fields(s.ranked), "recommended_candidates": pool, "lag_scores": s.lag_scores, "lag_peak_quality": s.peaks, "diagnostics": s.diagnostics,
        "residual_corr_scores": outputs.residual_order(s.residual, s.ranked), "regime_stability": s.regimes, "rolling_corr_scores": s.rolling, "redundancy": s.redundant,
        "review_pool": stages.review_pool(s.ranked, config.top_k, list(config.forced)), "overview": stages.overview(s.ranked, pool),
    }


def analyze(spark: SparkSession, wide: DataFrame, config: Config, folder: str) -> dict[str, str]:
    """Screens and publishes the branches and their comparison; the raw one is confirmed at first. Returns the versions."""
    modes = {"raw": "raw"} | ({"processed": config.mode} if config.mode != "raw" else {})
    versions = {}
    for branch, mode in modes.items():
        own = replace(config, mode=mode)
        s = screen(wide, own)
        versions[branch] = outputs.publish(branch_tables(s, own), f"{folder}/{branch}", {"mode": mode, "gap_starts": list(s.frame.starts), "period": s.period, "rows": s.frame.rows})
        s.release()
    outputs.save_config(spark, folder, config.to_json())
    confirm_branch(spark, folder, "raw")
    if "processed" in modes:
        side = lambda b: outputs.read_optional(spark, f"{folder}/{b}", "ranked_features").select("variable", F.col("driver_rank").alias("rank"), "lag", F.col("final_score").alias("score"))
        outputs.publish({"preprocessing_comparison": joins.compare_branches(side("raw"), side("processed"), config.top_k)}, f"{folder}/comparison")
    return versions


def confirm_branch(spark: SparkSession, folder: str, branch: str) -> None:
    """Makes a branch the formal result; one that was not screened is an error."""
    if branch not in BRANCHES or outputs.current(f"{folder}/{branch}", spark) is None:
        raise ValueError(f"no branch {branch} in {folder}")
    outputs.write_text(spark, f"{folder}/formal.json", json.dumps({"branch": branch, "version": outputs.current(f"{folder}/{branch}", spark)["version"]}))


def formal(spark: SparkSession, folder: str) -> tuple[Config, str]:
    """The configuration of the confirmed branch, and its folder; a branch that was screened anew since must be confirmed anew."""
    text = outputs.read_text(spark, f"{folder}/formal.json")
    if text is None:
        raise ValueError(f"{folder} has no confirmed branch")
    found = json.loads(text)
    now = outputs.current(f"{folder}/{found['branch']}", spark)
    if now["version"] != found["version"]:
        raise ValueError("the confirmed branch was screened anew: confirm it again")
    return replace(Config.from_json(outputs.load_config(spark, folder)), mode=now["about"]["mode"]), f"{folder}/{found['branch']}"


def ready(wide: DataFrame, config: Config) -> tuple[Frame, DataFrame]:
    """The prepared frame of a configuration and its stored long table."""
    frame, long = prepared(wide, config)
    return frame, stored(long)


def enhanced(spark: SparkSession, wide: DataFrame, folder: str) -> str:
    """Model lift and rolling correlation of the confirmed branch, side by side with its ranking."""
    config, branch = formal(spark, folder)
    frame, long = ready(wide, config)
    ranked, rolling = (outputs.read_optional(spark, branch, name) for name in ("ranked_features", "rolling_corr_scores"))
    lift = stored(causality.model_lift(long, config.target, ranked, config.max_lag, frame.period))
    version = outputs.publish({"model_lift_scores": lift, "rolling_corr_scores": rolling, "enhanced_validation_summary": stages.enhanced_summary(ranked, lift, rolling)}, f"{folder}/enhanced")
    forget(lift, long, *frame.held)
    return version


def granger(spark: SparkSession, wide: DataFrame, folder: str, max_lag: int | None = None) -> str:
    config, _ = formal(spark, folder)
    frame, long = ready(wide, config)
    version = outputs.publish({"granger_tests": stages.granger_order(causality.granger(long, config.target, max_lag or config.max_lag, frame.period))}, f"{folder}/granger")
    forget(long, *frame.held)
    return version


def model(spark: SparkSession, wide: DataFrame, folder: str, most_features: int = 300) -> str:
    """A forest on lags around each variable's best, its importance by variable, and what it finds beyond the first ranks."""
    config, branch = formal(spark, folder)
    frame, long = ready(wide, config)
    ranked = outputs.read_optional(spark, branch, "ranked_features")
    lags = {r["variable"]: r["lag"] for r in ranked.select("variable", "lag").collect()}  # a row a variable
    features = [(config.target, 1), *[(v, k) for v, lag in sorted(lags.items()) for k in validation.candidate_lags(lag, config.max_lag)]][:most_features]
    table = long.groupBy("t").pivot("variable", list(frame.variables)).agg(F.first("value", True))
    rows = validation.lag_features(table, features, frame.period).join(table.select("t", config.target), "t")
    importance = validation.forest_importance(rows, [f"{v}__lag_{k}" for v, k in features], config.target)
    found = stages.discovered(importance, ranked, max_lag=config.max_lag)
    tables = {"model_importance": importance, "model_variable_importance": validation.variable_importance(importance), "model_discovered_candidates": found, "discovery_candidates": stages.discovery_candidates(found, ranked, config.top_k)}
    version = outputs.publish(tables, f"{folder}/model")
    forget(long, *frame.held)
    return version


def causal_review(spark: SparkSession, wide: DataFrame, folder: str, controls: list[str], max_lag: int | None = None, min_rows: int = 60, top_n: int | None = None) -> str:
    """Conditional Granger tests of the review candidates, decisions and the final review order."""
    config, branch = formal(spark, folder)
    controls = controls or list(config.controls)
    frame, long = ready(wide, config)
    ranked = outputs.read_optional(spark, branch, "ranked_features")
    queue = review.review_candidates(ranked)
    if top_n:
        queue = queue.where(F.col("driver_rank") <= top_n)
    tests = stored(causality.conditional_granger(long, config.target, controls, max_lag or config.max_lag, frame.period, min_rows=min_rows))
    key = F.struct(F.coalesce("q", F.lit(2.0)), F.coalesce("p", F.lit(2.0)), -F.coalesce("contribution", F.lit(0.0)), "lag")
    best = tests.groupBy("variable").agg(F.min_by("status", key).alias("conditional_status"), F.min_by("q", key).alias("conditional_q"), F.min_by("contribution", key).alias("predictive_contribution"), F.min_by("lag", key).alias("conditional_lag"))
    report = queue.join(best, "variable", "left").withColumn("decision", review.review_decision())
    level = F.when(F.col("strong_risk_count") > 0, "low").when(F.col("risk_count") > 1, "medium").otherwise("high")
    ordered = review.final_order(report.withColumn("data_priority", level))
    version = outputs.publish({"conditional_granger": tests, "causal_review_report": report, "final_review_summary": ordered}, f"{folder}/review")
    forget(tests, long, *frame.held)
    return version


def validate(spark: SparkSession, wide: DataFrame, folder: str, controls: list[str], forced: list[str] = (), top_n: int = 8, max_lag: int | None = None) -> str:
    """The out-of-time validation of the reviewed candidates, published whole or not at all; a broken bundle is an error."""
    config, branch = formal(spark, folder)
    reviewed = outputs.read_optional(spark, f"{folder}/review", "final_review_summary")
    if reviewed is None:
        raise ValueError("run the review first")
    pools = outputs.read_optional(spark, branch, "recommended_candidates").select("variable", "candidate_priority_rank", "candidate_pool_rank")
    plain = reviewed.select("variable", F.col("decision").alias("final_recommendation"), F.col("lag").alias("screening_lag"), "recommended_use", F.lit(None).cast("string").alias("candidate_class"), "risk_flags", "final_rank")
    pool = stages.candidate_pool(plain.join(pools, "variable", "left"), config.target, top_n=top_n, forced=list(forced), controls=controls)
    kept, starts = retained(wide, config)
    v = out_of_time.validate(kept, config.target, pool, controls, max_lag or config.max_lag, mode=config.mode, window=config.detrend_window, tau_minutes=config.lowpass_tau_minutes, limit=config.interpolate_limit, resample_seconds=config.resample_seconds, starts=starts)
    context = validation.fold_context(v.rows.withColumnRenamed("part", "partition"))
    broken = outputs.bundle_errors(v.fold_metrics, context, v.candidate_metrics, v.uplift).collect() if v.status != "insufficient_rows" else []  # a row a rule
    state = v.status if not broken else "incomplete_outputs"
    tables = {"candidate_pool": pool, "fold_context": context, "fold_metrics": v.fold_metrics, "model_summary": v.model_summary, "candidate_fold_metrics": v.candidate_metrics, "candidate_uplift": v.uplift, "fingerprint": v.fingerprint}
    version = outputs.publish(tables, f"{folder}/validation", {"status": state, "broken": [r["rule"] for r in broken]})
    v.release()
    return version

