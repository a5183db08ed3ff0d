"""Tables of the later stages: candidate pools and orders, discovery, review pools, validation fields, model summaries, baseline metrics.

All of them hold a row a variable (or a variable and fold); what they add to a ranking is
never written back to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import finite
from .validation import uplift_status

# Fixed values of the rules.
AUTO_MOST = 10
MOST_CANDIDATES = 12
ALLOWED_RECOMMENDATIONS = ["priority_review", "priority_review_with_statistical_limit", "secondary_review", "secondary_review_with_statistical_limit", "risk_limited_review"]
EXCLUDED_CLASSES = ["downstream_response", "formula_or_derived", "poor_quality"]
EXCLUDED_RISKS = ["strong_formula_leakage", "severe_data_quality", "target_leads_variable"]
DISCOVERY_WINDOW = 10
DISCOVERY_MOST = 5
WEAK_DIRECTION = 0.05
LOOP = "^(FIC|TIC|PIC|AIC|LIC|FRC|TRC|PRC|ARC|LRC|FC|TC|PC|AC|LC)"
MEASURED_LOOP = "^(AIC|AI|TIC|TI|PIC|PI)"
BARRED_FROM_CONTROL = ["target_leads_variable", "strong_formula_leakage", "weak_or_incomplete_evidence"]
CONTROL_DOWNGRADES = ["common_capacity_driver", "high_collinearity_risk", "fallback_missing_ranked_lag"]
WRITABLE = ["apc", "write", "writable", "remote set", "remote_set", "可写入", "写入点", "远程设定值"]
FEEDFORWARD = ["load", "feed", "flow", "负荷", "流量", "进料"]


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def has_flag(flags: str, wanted: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.col(flags), ";"), wanted), F.lit(False))


def any_text(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


# ------------------------------------------------------------------ pools and orders
def exclusion_reasons(target: str, controls: list[str]) -> Column:
    """Why a reviewed variable can't be a candidate by itself, joined by ;."""
    reasons = [
        F.when(F.col("variable") == target, "target_variable"),
        F.when(~F.coalesce(F.col("final_recommendation").isin(ALLOWED_RECOMMENDATIONS), F.lit(False)), "recommendation_not_eligible"),
        F.when(F.coalesce("screening_lag", F.lit(0)) <= 0, "non_positive_screening_lag"),
        F.when(F.col("variable").isin(controls) if controls else F.lit(False), "control_variable"),
        F.when(F.coalesce(F.col("recommended_use") == "control_variable_reference", F.lit(False)), "control_reference"),
        F.when(F.col("candidate_class").isin(EXCLUDED_CLASSES), F.col("candidate_class")),
        *[F.when(has_flag("risk_flags", f), f) for f in EXCLUDED_RISKS],
    ]
    return F.array_join(F.array_compact(F.array(*reasons)), ";")


def candidate_pool(reviewed: DataFrame, target: str, *, top_n: int = 8, forced: list[str] = (), controls: list[str] = ()) -> DataFrame:
    """The variables of the out-of-time validation: the first top_n eligible ones by priority, final and pool rank, then forced ones.

    reviewed: variable, final_recommendation, screening_lag, recommended_use, candidate_class, risk_flags and the three ranks.
    """
    if not 1 <= top_n <= AUTO_MOST:
        raise ValueError(f"top_n is 1 to {AUTO_MOST}")
    wanted = [v for v in dict.fromkeys(forced) if v and v != target]
    rows = first_rows(reviewed.where("variable is not null and trim(variable) <> ''"), "variable", [F.asc_nulls_last("final_rank")])
    rows = rows.withColumn("auto_exclusion_reasons", exclusion_reasons(target, list(controls))).withColumn("auto_eligible", F.col("auto_exclusion_reasons") == "")
    order = [F.asc_nulls_last(c) for c in ("candidate_priority_rank", "final_rank", "candidate_pool_rank")]
    picked = rows.where("auto_eligible").withColumn("_auto", F.row_number().over(Window.orderBy(*order, "variable"))).where(F.col("_auto") <= top_n).select("variable", "_auto")
    place = reviewed.sparkSession.createDataFrame([(v, i) for i, v in enumerate(wanted)], "variable string, _forced int")
    known = rows.join(picked, "variable", "left").join(place, "variable", "full_outer").where("_auto is not null or _forced is not null")
    source = F.when(F.col("_auto").isNull(), "whitelist").when(F.col("_forced").isNull(), "final_review").otherwise("final_review+whitelist")
    out = known.withColumns({"selection_source": source, "force_included": F.col("_forced").isNotNull(), "auto_eligible": F.coalesce("auto_eligible", F.lit(False))})
    out = out.withColumn("candidate_order", F.row_number().over(Window.orderBy(F.asc_nulls_last("_auto"), F.asc_nulls_last("_forced"), "variable"))).drop("_auto", "_forced")
    if out.count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    return out


def review_pool(ranked: DataFrame, top_k: int, manual: list[str] = ()) -> DataFrame:
    """variable, candidate_source, source_rank: the first top_k of the ranking, then variables added by hand that are not among them."""
    order = ranked.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(v for v in manual if v))], "variable string, _place int")
    rows = ranked.select("variable", F.col("driver_rank").alias("source_rank"))
    first = rows.where(F.col("source_rank") <= top_k).select("variable", F.lit("initial_screening").alias("candidate_source"), "source_rank", F.col("source_rank").alias("_o"))
    added = order.join(rows, "variable", "left").join(first, "variable", "left_anti").select("variable", F.lit("manual_include").alias("candidate_source"), "source_rank", (F.col("_place") + top_k + 1).alias("_o"))
    return first.unionByName(added).withColumn("pool_order", F.row_number().over(Window.orderBy("_o"))).drop("_o")


def secondary_variables(ranked: DataFrame, top_k: int, forced: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """variable, place: the best top_k by final score, then forced and further ones, each once (an ordered union)."""
    best = ranked.select("variable", F.row_number().over(Window.orderBy(F.desc_nulls_last("final_score"), "driver_rank")).cast("long").alias("place")).where(F.col("place") <= top_k)
    more = ranked.sparkSession.createDataFrame([(v, top_k + 1 + i) for i, v in enumerate([*forced, *extra]) if v], "variable string, place long")
    both = best.unionByName(more).groupBy("variable").agg(F.min("place").alias("place"))
    return both.withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


def exploration_window(ranked: DataFrame, top_k: int, size: int = DISCOVERY_WINDOW) -> DataFrame:
    """variable, source_rank of the ranks just behind the first top_k."""
    return ranked.where(F.col("driver_rank").between(top_k + 1, top_k + min(size, DISCOVERY_WINDOW))).select("variable", F.col("driver_rank").alias("source_rank"))


def discovery_candidates(discovered: DataFrame, ranked: DataFrame, top_k: int, most: int = DISCOVERY_MOST) -> DataFrame:
    """Those of the exploration window that a model found, in the order of the ranking."""
    found = exploration_window(ranked, top_k).join(discovered.select("variable", "discovery_reason"), "variable")
    return found.withColumn("_n", F.row_number().over(Window.orderBy("source_rank"))).where(F.col("_n") <= min(most, DISCOVERY_MOST)).drop("_n")


def discovered(importance: DataFrame, ranked: DataFrame, *, screening_top: int = 30, model_top: int = 50, max_lag: int | None = None) -> DataFrame:
    """Variables behind the model's most important features (name__lag_k), and what makes them worth a look."""
    top = importance.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).where(F.col("importance_rank") <= model_top)
    lag = F.regexp_extract("feature", r"__lag_(\d+)$", 1)
    top = top.withColumns({"variable": F.regexp_replace("feature", r"__lag_\d+$", ""), "lag": F.when(lag != "", lag.cast("int"))})
    g = top.groupBy("variable").agg(
        F.min_by("feature", "importance_rank").alias("best_model_feature"), F.min_by("lag", "importance_rank").alias("best_model_lag"), F.max("importance").alias("max_importance"),
        F.min("importance_rank").alias("importance_rank"), F.count(F.lit(1)).alias("model_feature_count"), F.countDistinct("lag").alias("nearby_lag_count"),
    )
    out = g.join(ranked.select("variable", F.col("driver_rank").alias("ranked_feature_rank"), F.col("final_score").alias("ranked_final_score"), "risk_flags", "recommended_use"), "variable", "left")
    out = out.withColumn("in_screening_top_n", F.coalesce(F.col("ranked_feature_rank") <= screening_top, F.lit(False)))
    flagged = lambda *names: any_text(F.coalesce("risk_flags", F.lit("")), list(names))
    near_end = F.lit(False) if max_lag is None else F.coalesce(F.col("best_model_lag") >= max_lag - 2, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~F.col("in_screening_top_n"), "model_only_signal"), F.when(F.col("model_feature_count") >= 3, "multi_lag_model_signal"), F.when(near_end, "model_lag_boundary_risk"),
        F.when(F.col("best_model_lag") == 0, "synchronous_or_leakage_risk"), F.when(flagged("lag_boundary"), "screening_lag_boundary_risk"),
        F.when(flagged("target_leads_variable"), "target_lead_risk"), F.when(flagged("unstable_over_time", "unstable_across_regimes"), "stability_risk"),
    ))
    return out.withColumn("discovery_reason", F.when(F.size(reasons) > 0, F.array_join(reasons, ";")).otherwise("model_supported_screening_candidate"))


def with_ranked(selected: DataFrame, ranked: DataFrame, *, prefer_ranked_lag: bool = False) -> DataFrame:
    """selected with the ranking's columns: its own values first, the ranking's where it has none (its lag always, if preferred)."""
    other = [c for c in ranked.columns if c != "variable"]
    right = first_rows(ranked, "variable", [F.asc("driver_rank")]).select("variable", *[F.col(c).alias(f"_r_{c}") for c in other])
    both = selected.join(right, "variable", "left")
    pick = lambda c: F.col(f"_r_{c}") if c == "lag" and prefer_ranked_lag or c not in selected.columns else F.coalesce(c, f"_r_{c}")
    return both.select("variable", *[pick(c).alias(c) if c in other else F.col(c) for c in selected.columns if c != "variable"], *[pick(c).alias(c) for c in other if c not in selected.columns])


# ------------------------------------------------------------------ validation tables
def enhanced_summary(ranked: DataFrame, lift: DataFrame, rolling: DataFrame) -> DataFrame:
    """Every variable of any of the three tables, with what each says of it."""
    names = ranked.select("variable").union(lift.select("variable")).union(rolling.select("variable")).where("variable is not null").distinct()
    out = names.join(ranked.select("variable", "final_score", "lag", "direction", "risk_flags", "recommended_use"), "variable", "left")
    out = out.join(lift.select("variable", "status", "model_lift", "ar_baseline_rmse", "candidate_rmse"), "variable", "left")
    return out.join(rolling.select("variable", "rolling_stability", "rolling_corr_median", "rolling_sign_consistency", "valid_window_count"), "variable", "left")


def validation_fields(ranked: DataFrame, enhanced: DataFrame, lift: DataFrame, rolling: DataFrame, granger: DataFrame, conditional: DataFrame) -> DataFrame:
    """Lags and lifts of each stage side by side; an absent value stays null and lags keep their sign.

    The validation lag is the rolling one, else that of the enhanced summary, else Granger's. ranked and enhanced have lag and
    model_lift, lift model_lift, the others best_lag.
    """
    tables = {"ranked": ranked, "enhanced": enhanced, "lift": lift, "rolling": rolling, "granger": granger, "conditional": conditional}
    names = reduce(DataFrame.union, [t.select("variable") for t in tables.values()]).where("variable is not null").distinct()
    pick = lambda t, column, out: tables[t].groupBy("variable").agg(F.first(finite(F.col(column).cast("double"))).alias(out))
    for part in (
        pick("ranked", "lag", "initial_screening_lag"), pick("rolling", "best_lag", "_rolling"), pick("enhanced", "lag", "_enhanced"), pick("granger", "best_lag", "_granger"),
        pick("conditional", "best_lag", "conditional_validation_lag"), pick("ranked", "model_lift", "screening_model_lift"), pick("lift", "model_lift", "_lift"), pick("enhanced", "model_lift", "_enhanced_lift"),
    ):
        names = names.join(part, "variable", "left")
    return names.select(
        "variable", F.col("initial_screening_lag").cast("int").alias("initial_screening_lag"), F.coalesce("_rolling", "_enhanced", "_granger").cast("int").alias("validation_lag"),
        F.col("conditional_validation_lag").cast("int").alias("conditional_validation_lag"), "screening_model_lift", F.coalesce("_lift", "_enhanced_lift").alias("validation_model_lift"),
    )


def improvement(baseline: Column, other: Column) -> Column:
    """Per cent that other is below baseline; null for a baseline of 0."""
    return F.when(baseline != 0, (baseline - other) / F.nullif(baseline, F.lit(0.0)) * 100)


def candidate_uplift(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """variable, fold and how far each candidate's model is better than M1's of its fold."""
    base = baseline.select("fold", F.col("rmse").alias("baseline_rmse"), F.col("mae").alias("baseline_mae"))
    out = candidates.join(base, "fold")
    return out.withColumns({"rmse_improvement_pct": improvement(F.col("baseline_rmse"), F.col("rmse")), "mae_improvement_pct": improvement(F.col("baseline_mae"), F.col("mae"))})


def ordered_uplift(summary: DataFrame, order: DataFrame) -> DataFrame:
    """summary of every candidate in order (variable, candidate_order), ranked by the median gain; those without a model have too few features."""
    out = order.join(summary, "variable", "left").withColumn("fold_count", F.coalesce("fold_count", F.lit(0)))
    out = out.withColumn("validation_status", F.coalesce("validation_status", uplift_status()))
    return out.withColumn("uplift_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("median_rmse_improvement_pct"), "candidate_order")))


def model_summary(metrics: DataFrame) -> DataFrame:
    """Means and medians of each model over its folds; M2's gain over M1."""
    g = metrics.groupBy("model").agg(F.avg("rmse").alias("mean_rmse"), F.median("rmse").alias("median_rmse"), F.avg("mae").alias("mean_mae"), F.median("mae").alias("median_mae"), F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("fold_count"))
    base = metrics.where("model = 'M1'").agg(F.avg("rmse").alias("_rmse"), F.avg("mae").alias("_mae"))
    out = g.crossJoin(F.broadcast(base))  # one row
    better = lambda c: F.when(F.col("model") == "M2", improvement(F.col(f"_{c}"), F.col(f"mean_{c}")))
    return out.withColumns({"m2_vs_m1_rmse_improvement_pct": better("rmse"), "m2_vs_m1_mae_improvement_pct": better("mae")}).drop("_rmse", "_mae")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes with any value of the rows' keys, labels and columns, whatever their order: count, xor and sum of row hashes."""
    h = F.xxhash64("fold", "part", "t", "y", *[F.col(f"`{c}`") for c in columns])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def review_rollup(uplift: DataFrame, folds: DataFrame, context: DataFrame) -> DataFrame:
    """uplift with the time that its tests cover and, of each context value, the one that all folds share (null where they differ: see <name>_consistent).

    folds: variable, fold, test_start, test_end; context: fold and values.
    """
    cover = folds.where("test_start is not null and test_end is not null").groupBy("variable").agg(F.min("test_start").alias("tested_from"), F.max("test_end").alias("tested_to"))
    names = [c for c in context.columns if c != "fold"]
    same = {c: (F.countDistinct(c) == 1) & (F.count(c) == F.count(F.lit(1))) for c in names}
    one = context.agg(*[F.when(same[c], F.first(c, True)).alias(c) for c in names], *[F.coalesce(same[c], F.lit(False)).alias(f"{c}_consistent") for c in names])
    return uplift.join(cover, "variable", "left").crossJoin(F.broadcast(one))  # one row


# ------------------------------------------------------------------ displays and checks
def with_display_fields(ranked: DataFrame) -> DataFrame:
    """dominant_corr and correlation_direction; below WEAK_DIRECTION either way the direction is weak."""
    value = F.when(F.col("method") == "pearson", F.col("pearson")).when(F.col("method") == "spearman", F.col("spearman"))
    direction = F.when(F.col("dominant_corr").isNull(), "not_computed").when(F.col("dominant_corr") > WEAK_DIRECTION, "positive").when(F.col("dominant_corr") < -WEAK_DIRECTION, "negative").otherwise("weak")
    return ranked.withColumn("dominant_corr", finite(value)).withColumn("correlation_direction", direction)


def recommended_order(df: DataFrame) -> list[Column]:
    rank = next((c for c in ("candidate_priority_rank", "candidate_pool_rank") if c in df.columns), None)
    return [F.asc_nulls_last(rank), F.asc("variable")] if rank else []


def granger_order(df: DataFrame) -> DataFrame:
    """Numbers tests by their q-values, those without one last."""
    return df.withColumn("q_order", F.row_number().over(Window.orderBy(F.asc_nulls_last("q"), "variable", "lag")))


def control_role(df: DataFrame, names: str = "variable", notes: str = "risk_flags") -> DataFrame:
    """loop_tag, related points and the suggested control role of each variable, by its name's suffix, loop and notes.

    Related points are the variables of the same table that the loop's .SV and .MV would be called.
    """
    name = F.col(names)
    loop, suffix = F.regexp_extract(name, r"^(.+)\.([A-Za-z]+)$", 1), F.upper(F.regexp_extract(name, r"^(.+)\.([A-Za-z]+)$", 2))
    df = df.withColumns({"loop_tag": F.when(loop != "", loop), "_suffix": suffix})
    points = df.select(F.col(names).alias("_point"))
    for kind in ("sv", "mv"):
        wanted = points.select(F.col("_point").alias(f"related_{kind}")).distinct()
        df = df.withColumn("_wanted", F.concat("loop_tag", F.lit(f".{kind.upper()}"))).join(wanted, F.col("_wanted") == F.col(f"related_{kind}"), "left").drop("_wanted")
    text, low = F.lower(F.concat_ws(";", names, notes)), F.lower(name)
    tag = F.upper(F.coalesce("loop_tag", F.lit("")))
    writable = F.col("related_sv").isNotNull() | F.col("related_mv").isNotNull() | any_text(text, WRITABLE)
    role = (
        F.when(F.col("_suffix").isin("MV", "SV"), "mv_candidate")
        .when((F.col("_suffix") == "PV") & tag.rlike(LOOP) & (~tag.rlike(MEASURED_LOOP) | writable), "loop_mv_candidate")
        .when(any_text(low, FEEDFORWARD), "dv_feedforward_candidate")
        .when((F.col("_suffix") == "PV") | any_text(low, ["aic", "ai", "tic", "ti", "pic", "pi"]), "monitor_candidate").otherwise("manual_review_only")
    )
    downgraded = F.when(F.col("_role") == "mv_candidate", "monitor_candidate").when(F.col("_role").isin("loop_mv_candidate", "dv_feedforward_candidate"), "manual_review_only").otherwise(F.col("_role"))
    df = df.withColumn("_role", role)
    final = F.when(any_text(text, BARRED_FROM_CONTROL), "not_recommended_for_control").when(any_text(text, CONTROL_DOWNGRADES), downgraded).otherwise(F.col("_role"))
    return df.withColumn("suggested_control_role", final).drop("_role", "_suffix")


def overview(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of counts."""
    n = ranked.agg(
        F.count(F.lit(1)).alias("effective_variables"), F.count_if(F.col("risk_count") > 0).alias("risk_tagged_count"),
        F.count_if(F.coalesce("is_control_reference", F.lit(False))).alias("control_reference_count"), F.count_if(F.col("candidate_grade").isin("A", "B")).alias("good_grades"),
    )
    return n.crossJoin(pool.agg(F.count(F.lit(1)).alias("recommended_candidate_count")))  # one row each


def trend_bounds(times: DataFrame, most: int, start: int | None = None) -> DataFrame:
    """lo, hi: from start (or the first time) as far as `most` points at the median step reach, to the last time at most."""
    step = (F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("step")
    steps = times.select("t").distinct().select("t", step)
    g = steps.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("step"))
    lo = F.col("first") if start is None else F.lit(start).cast("long")
    return g.select(lo.alias("lo"), F.least((lo + F.floor((most - 1) * F.coalesce("step", F.lit(0)))).cast("long"), F.col("last")).alias("hi"))


def expectation_errors(expected: DataFrame) -> DataFrame:
    """(rule, n) of broken rules of an expectation table (variable, expected_class)."""
    classes = ["reasonable_driver", "implausible_driver", "neutral"]
    blank = expected.where("variable is null or trim(variable) = ''").agg(F.count(F.lit(1)).alias("n")).select(F.lit("variable required").alias("rule"), "n")
    doubled = expected.groupBy("variable").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("doubled variable").alias("rule"), "n")
    unknown = expected.where(~F.coalesce(F.col("expected_class").isin(classes), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown class").alias("rule"), "n")
    return blank.union(doubled).union(unknown).where("n > 0")


def baseline_metrics(ranked: DataFrame, expected: DataFrame, cutoffs: list[int]) -> DataFrame:
    """A row a cutoff: hits, recalls and shares of expected drivers among the first ones, and how many of those carry risks."""
    total = expected.agg(F.count_if(F.col("expected_class") == "reasonable_driver").alias("_reasonable"))
    rows = ranked.select("variable", "driver_rank", "candidate_grade", "risk_flags").join(expected.select("variable", "expected_class"), "variable", "left")
    known = rows.agg(F.count_if(F.col("expected_class") == "reasonable_driver").alias("_found"))
    at = rows.withColumn("cutoff", F.explode(F.array(*[F.lit(int(c)) for c in cutoffs]))).where(F.col("driver_rank") <= F.col("cutoff"))
    good = F.col("candidate_grade").isin("A", "B")
    quality = has_flag("risk_flags", "poor_data_quality") | has_flag("risk_flags", "severe_data_quality")
    flags = ["target_leads_variable", "common_capacity_driver", "strong_formula_leakage", "lag_boundary", "poor_data_quality", "severe_data_quality"]
    g = at.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("available_rows"), F.count_if(F.col("expected_class") == "reasonable_driver").alias("reasonable_hits"), F.count_if(F.col("expected_class") == "implausible_driver").alias("implausible_hits"),
        F.count_if(quality).alias("data_quality_risk_count"), *[F.count_if(has_flag("risk_flags", f)).alias(f"{f}_count") for f in flags], *[F.count_if(good & has_flag("risk_flags", f)).alias(f"ab_{f}_count") for f in flags if f != "lag_boundary"],
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    out = g.crossJoin(total).crossJoin(known)  # one row each
    return out.withColumns({"recall_of_expected": ratio("reasonable_hits", "_reasonable"), "recall_of_found": ratio("reasonable_hits", "_found"), "implausible_share": ratio("implausible_hits", "available_rows")}).drop("_reasonable", "_found")
