"""DuckDB SQL that gives the same rows as the queries, written on its own."""

from __future__ import annotations

from .frames import CONTROL, MAX_LAG, PERIOD, RULES, TARGET, VARIABLES

E9 = 6

K = f"""ev AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS t, event_type AS variable, value, event_id FROM events),
k AS (SELECT t - t % {PERIOD} AS t, variable, median(value) AS value FROM ev GROUP BY 1, 2),
h AS (SELECT a.t, v.variable, k.value FROM (SELECT DISTINCT t FROM k) a CROSS JOIN (SELECT unnest({VARIABLES}) AS variable) v LEFT JOIN k ON k.t = a.t AND k.variable = v.variable),
w AS (SELECT t, {', '.join(f"max(value) FILTER (variable = '{v}') AS {v}" for v in VARIABLES)} FROM h GROUP BY t)"""

R = "r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RULES.items()) + ", p_partkey AS part FROM part)"

PAIRS = f"""pairs AS (SELECT x.variable, l.lag, y.t, x.value AS x, y.value AS y FROM h x CROSS JOIN (SELECT unnest(range(-{MAX_LAG}, {MAX_LAG} + 1)) AS lag) l
JOIN h y ON y.variable = '{TARGET}' AND y.t = x.t + l.lag * {PERIOD} WHERE x.variable <> '{TARGET}' AND x.value IS NOT NULL AND y.value IS NOT NULL)"""


def corr(x: str, y: str, n: int = 5) -> str:
    return f"CASE WHEN count(*) >= {n} AND min({x}) <> max({x}) AND min({y}) <> max({y}) THEN greatest(-1.0, least(1.0, covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))) END"


def scores(keys: str, source: str = "pairs", name: str = "s") -> str:
    return f"""{name}_ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM {source}),
{name} AS (SELECT {keys}, count(*) AS n, {corr('x', 'y')} AS pearson, {corr('rx', 'ry')} AS spearman FROM {name}_ranked GROUP BY {keys})"""


def best(keys: str, source: str = "s", name: str = "b") -> str:
    return f"""{name}_sup AS (SELECT *, greatest(abs(pearson), abs(spearman)) AS score FROM {source} QUALIFY n >= least(20, greatest(8, ceil(max(n) OVER (PARTITION BY {keys}) * 0.5)))),
{name} AS (SELECT *, CASE WHEN abs(pearson) >= abs(spearman) THEN pearson ELSE spearman END AS signed, CASE WHEN abs(pearson) >= abs(spearman) THEN 'pearson' ELSE 'spearman' END AS method
 FROM {name}_sup WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, lag) = 1)"""


S = scores("variable, lag")
B = best("variable")


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, {E9}) AS {c}" for c in columns)


FORMULA = "(lower(variable) LIKE '%ratio%' OR lower(variable) LIKE '%rate%' OR contains(variable, '%') OR lower(variable) LIKE '%total%' OR lower(variable) LIKE '%consumption%' OR lower(variable) LIKE '%specific%')"
CLIP = "greatest(0.0, least(1.0, {}))".format

SCORED = f"""sc0 AS (SELECT *, {CLIP('association_score')} * {CLIP('data_quality_score')} AS base_score, CASE WHEN residual_status = 'ok' AND residual_corr IS NOT NULL THEN {CLIP('residual_corr')} END AS residual_support,
 CASE WHEN rolling_sign_consistency IS NOT NULL AND rolling_corr_iqr IS NOT NULL THEN {CLIP('rolling_sign_consistency * (1 - least(1.0, rolling_corr_iqr))')} END AS rolling_support,
 CASE WHEN regime_evidence_status IN ('ok', 'full_coverage', 'partial_coverage') AND regime_coverage IS NOT NULL THEN {CLIP('regime_coverage * regime_sign_consistency * (0.6 * regime_strength_consistency + 0.4 * regime_lag_consistency)')} END AS regime_support FROM r),
sc1 AS (SELECT *, CASE WHEN rolling_support IS NOT NULL AND regime_support IS NOT NULL THEN sqrt(rolling_support * regime_support) ELSE coalesce(rolling_support, regime_support) END AS stability_support FROM sc0),
sc2 AS (SELECT *, greatest(0.0, least(0.2, 0.1 * coalesce(residual_support, 0) + 0.1 * coalesce(stability_support, 0))) AS support_bonus_rate FROM sc1),
sc3 AS (SELECT *, least(1.0, base_score * (1 + support_bonus_rate)) AS evidence_score FROM sc2),
scored AS (SELECT *, CASE WHEN temporal_direction_status = 'target_leads_supported' THEN least(evidence_score * 0.5, 0.25) ELSE evidence_score END AS final_score FROM sc3)"""

POOR = "(missing_rate > 0.2 OR saturation_ratio > 0.2 OR abnormal_jump_ratio > 0.01 OR robust_outlier_ratio > 0.01)"
SEVERE = "(missing_rate > 0.5 OR saturation_ratio > 0.8 OR abnormal_jump_ratio > 0.05 OR robust_outlier_ratio > 0.05)"
FLAGGED = f"""fl0 AS (SELECT *, list_filter([
 CASE WHEN {FORMULA} THEN 'formula_like' END, CASE WHEN {FORMULA} AND raw_corr > 0.98 AND lag = 0 THEN 'strong_formula_leakage' END,
 CASE WHEN residual_status = 'ok' AND raw_corr >= 0.5 AND coalesce(residual_corr, raw_corr) < raw_corr * 0.65 THEN 'common_capacity_driver' END,
 CASE WHEN redundant THEN 'redundant_proxy' END, CASE WHEN temporal_direction_status = 'target_leads_supported' THEN 'target_leads_variable' END,
 CASE WHEN regime_evidence_status IN ('partial_coverage', 'full_coverage') AND regime_stability_final < 0.5 THEN 'unstable_across_regimes' END,
 CASE WHEN coalesce(rolling_stability, 1) < 0.35 AND NOT coalesce(lift_status = 'ok' AND model_lift >= 0.05 AND raw_corr < 0.2, false) THEN 'unstable_over_time' END,
 CASE WHEN lag_boundary_flag THEN 'lag_boundary' END, CASE WHEN lift_status = 'ok' AND model_lift < 0.01 THEN 'low_model_lift' END,
 CASE WHEN {POOR} AND NOT {SEVERE} THEN 'poor_data_quality' END, CASE WHEN {SEVERE} THEN 'severe_data_quality' END,
 CASE WHEN residual_status IN ('ok', 'rank_deficient') AND condition_number > 1e8 THEN 'residual_collinearity' END], lambda x: x IS NOT NULL) AS flags FROM scored),
fl1 AS (SELECT *, len(flags) AS risk_count, len(list_filter(flags, lambda x: x IN ('strong_formula_leakage', 'common_capacity_driver', 'severe_data_quality'))) AS strong_risk_count FROM fl0),
flagged AS (SELECT *, CASE WHEN risk_count = 0 THEN 'none' WHEN strong_risk_count >= 2 THEN 'strong' WHEN strong_risk_count = 1 THEN 'medium' ELSE 'weak' END AS risk_level, array_to_string(flags, ';') AS risk_flags,
 CASE WHEN final_score >= 0.75 THEN 'A' WHEN final_score >= 0.6 THEN 'B' WHEN final_score >= 0.45 THEN 'C' WHEN final_score >= 0.3 THEN 'D' ELSE 'E' END AS candidate_grade FROM fl1),
used AS (SELECT *, CASE WHEN list_contains(flags, 'severe_data_quality') THEN 'poor_quality_variable'
 WHEN list_contains(flags, 'strong_formula_leakage') OR (list_contains(flags, 'formula_like') AND list_contains(flags, 'common_capacity_driver')) OR (list_contains(flags, 'formula_like') AND lag = 0 AND raw_corr >= 0.95) THEN 'formula_coupled_reference'
 WHEN temporal_direction_status = 'target_leads_supported' THEN 'state_indicator' WHEN list_contains(flags, 'common_capacity_driver') THEN 'capacity_driven'
 WHEN list_contains(flags, 'unstable_across_regimes') OR list_contains(flags, 'unstable_over_time') THEN 'unstable_candidate' WHEN candidate_grade = 'A' THEN 'strong_screening_candidate' ELSE 'manual_review_required' END AS recommended_use FROM flagged)"""

POOL = """raws AS (SELECT variable, rn AS raw_candidate_rank FROM (SELECT variable, row_number() OVER (ORDER BY final_score DESC NULLS LAST, association_score DESC NULLS LAST, lag_quality DESC NULLS LAST, variable) AS rn FROM used WHERE NOT is_control_reference AND final_score >= 0.3) WHERE rn <= 20),
usable AS (SELECT * FROM used WHERE NOT is_control_reference AND residual_status IN ('ok', 'rank_deficient') AND residual_n > 0 AND residual_corr IS NOT NULL),
ress AS (SELECT variable, rn AS residual_candidate_rank FROM (SELECT variable, row_number() OVER (ORDER BY residual_corr DESC, residual_lag_quality DESC, residual_n DESC, CASE WHEN residual_status = 'ok' THEN 0 ELSE 1 END, variable) AS rn FROM usable WHERE residual_corr >= 0.3 AND residual_n >= 30 AND residual_lag_quality IS NOT NULL) WHERE rn <= 20),
p0 AS (SELECT u.*, raw_candidate_rank, residual_candidate_rank, raw_candidate_rank IS NOT NULL AS selected_by_raw, residual_candidate_rank IS NOT NULL AS selected_by_residual, CASE u.variable WHEN 'v3' THEN 1 WHEN 'v31' THEN 2 ELSE 0 END AS forced,
 EXISTS (SELECT 1 FROM usable z WHERE z.variable = u.variable) AS known FROM used u LEFT JOIN raws USING (variable) LEFT JOIN ress USING (variable)),
p1 AS (SELECT *, CASE WHEN is_control_reference THEN 'control_reference' WHEN selected_by_raw AND selected_by_residual THEN 'raw_and_residual' WHEN selected_by_raw THEN 'raw_only' WHEN selected_by_residual THEN 'residual_only' ELSE 'force_included' END AS candidate_source,
 coalesce(selected_by_raw AND NOT selected_by_residual AND known AND raw_corr >= 0.5 AND residual_corr < raw_corr * 0.65, false) AS common_capacity_candidate_flag FROM p0 WHERE selected_by_raw OR selected_by_residual OR forced > 0),
pool AS (SELECT *, row_number() OVER (ORDER BY CASE candidate_source WHEN 'raw_and_residual' THEN 0 WHEN 'raw_only' THEN 1 WHEN 'residual_only' THEN 1 WHEN 'force_included' THEN 2 ELSE 3 END, least(raw_candidate_rank, residual_candidate_rank) NULLS LAST, raw_candidate_rank NULLS LAST, residual_candidate_rank NULLS LAST, nullif(forced, 0) NULLS LAST, variable) AS candidate_pool_rank FROM p1)"""

TIERS = f"""t0 AS (SELECT *, coalesce(residual_status IN ('ok', 'rank_deficient') AND residual_corr IS NOT NULL AND residual_lag_quality IS NOT NULL, false) AS complete FROM pool),
t1 AS (SELECT *, CASE WHEN complete THEN ({CLIP('residual_corr')} + {CLIP('residual_lag_quality')}) / 2 END AS signal,
 CASE WHEN candidate_source = 'control_reference' THEN 'control_reference' WHEN NOT complete THEN 'insufficient' WHEN residual_corr >= 0.3 AND residual_n >= 30 THEN 'strong' ELSE 'weak' END AS ev FROM t0),
t2 AS (SELECT *, CASE WHEN candidate_source = 'control_reference' THEN 'control_reference' WHEN selected_by_raw AND selected_by_residual THEN 'dual_channel_supported' WHEN selected_by_residual THEN 'residual_only_supported'
 WHEN selected_by_raw AND common_capacity_candidate_flag THEN 'raw_only_common_load_risk' WHEN selected_by_raw AND ev = 'weak' THEN 'raw_only_residual_weak' WHEN selected_by_raw AND ev = 'insufficient' THEN 'raw_only_residual_missing' WHEN selected_by_raw THEN 'raw_only_supported' ELSE 'force_included_only' END AS status,
 CASE WHEN selected_by_raw AND selected_by_residual THEN 0.6 * final_score + 0.4 * signal WHEN selected_by_raw THEN final_score WHEN selected_by_residual THEN signal END AS pscore FROM t1),
t3 AS (SELECT *, CASE status WHEN 'dual_channel_supported' THEN 0 WHEN 'raw_only_supported' THEN 1 WHEN 'residual_only_supported' THEN 1 WHEN 'raw_only_residual_weak' THEN 1 WHEN 'raw_only_residual_missing' THEN 1 WHEN 'raw_only_common_load_risk' THEN 2 WHEN 'force_included_only' THEN 3 ELSE 4 END AS tier FROM t2)"""

LIMITED = "(regexp_matches(risk_flags, 'common_capacity_driver|unstable_candidate|unstable_across_regimes|unstable_over_time') OR recommended_use IN ('capacity_driven', 'unstable_candidate'))"
ROLL = f"""rb AS (SELECT p.variable, p.t, p.x, p.y FROM pairs p JOIN b ON b.variable = p.variable AND b.lag = p.lag),
rseg AS (SELECT *, sum(CASE WHEN t - pt <> {PERIOD} THEN 1 ELSE 0 END) OVER (PARTITION BY variable ORDER BY t) AS segment FROM (SELECT *, lag(t) OVER (PARTITION BY variable ORDER BY t) AS pt FROM rb)),
rw AS (SELECT variable, t, count(*) OVER z AS n, sum(x) OVER z AS sx, sum(y) OVER z AS sy, sum(x * x) OVER z AS sxx, sum(y * y) OVER z AS syy, sum(x * y) OVER z AS sxy FROM rseg WINDOW z AS (PARTITION BY variable, segment ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
roll AS (SELECT variable, t, greatest(-1.0, least(1.0, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))) AS r FROM rw WHERE n >= 12 AND n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9)"""
REG = f"""q AS (SELECT quantile_cont(value, 1/3::DOUBLE) AS q1, quantile_cont(value, 2/3::DOUBLE) AS q2 FROM h WHERE variable = '{CONTROL}' AND value IS NOT NULL),
reg AS (SELECT t, CASE WHEN value <= q1 THEN 'low' WHEN value <= q2 THEN 'mid' ELSE 'high' END AS regime FROM h, q WHERE variable = '{CONTROL}' AND value IS NOT NULL),
rp AS (SELECT p.*, regime FROM pairs p JOIN reg USING (t) WHERE variable <> '{CONTROL}'),
{scores('variable, regime, lag', 'rp', 'rs')},
{best('variable, regime', 'rs', 'rbest')}"""
DIAG = """dd AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY variable ORDER BY t)) AS d FROM h),
st AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS med FROM h WHERE value IS NOT NULL GROUP BY 1),
mo AS (SELECT variable, max(n) / sum(n) AS saturation_ratio FROM (SELECT variable, value, count(*) AS n FROM h WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
ma AS (SELECT variable, median(abs(value - med)) AS mad FROM h JOIN st USING (variable) WHERE value IS NOT NULL GROUP BY 1),
g1 AS (SELECT variable, max(n) AS longest_missing_run FROM (SELECT variable, g, count(*) AS n FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY t) - row_number() OVER (PARTITION BY variable, value IS NULL ORDER BY t) AS g FROM h) WHERE value IS NULL GROUP BY 1, 2) GROUP BY 1),
g2 AS (SELECT variable, max(n) AS constant_run_max FROM (SELECT variable, g, count(*) AS n FROM (SELECT variable, sum(c) OVER (PARTITION BY variable ORDER BY t) AS g FROM (SELECT variable, t, CASE WHEN value <> lag(value) OVER (PARTITION BY variable ORDER BY t) THEN 1 ELSE 0 END AS c FROM h WHERE value IS NOT NULL)) GROUP BY 1, 2) GROUP BY 1),
diag AS (SELECT variable, 1 - count(value) / count(*) AS missing_rate, any_value(coalesce(longest_missing_run, 0)) AS longest_missing_run, any_value(constant_run_max) AS constant_run_max, count(*) FILTER (q3 > q1 AND d > 10 * (q3 - q1)) AS abnormal_jump_count,
 count(*) FILTER (q3 > q1 AND d > 10 * (q3 - q1)) / count(d) AS abnormal_jump_ratio, CASE WHEN count(value) >= 10 THEN count(*) FILTER (mad > 1e-12 AND 0.6745 * abs(value - med) / mad > 6) / count(value) ELSE 0 END AS robust_outlier_ratio, any_value(saturation_ratio) AS saturation_ratio
 FROM dd JOIN st USING (variable) JOIN ma USING (variable) JOIN mo USING (variable) LEFT JOIN g1 USING (variable) LEFT JOIN g2 USING (variable) GROUP BY variable)"""
NOTNULL = f"nn AS (SELECT t FROM h WHERE variable = '{TARGET}' AND value IS NOT NULL)"


def segs(test: str) -> str:
    return f"sg AS (SELECT t, sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (ORDER BY t) AS segment FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM nn))"


JOINT = f"c AS (SELECT x.t, x.variable, x.value AS x, y.value AS y, z.value AS z FROM h x JOIN h y ON y.t = x.t AND y.variable = '{TARGET}' JOIN h z ON z.t = x.t AND z.variable = '{CONTROL}' WHERE x.variable NOT IN ('{TARGET}', '{CONTROL}') AND x.value IS NOT NULL AND y.value IS NOT NULL AND z.value IS NOT NULL)"
RESPAIRS = f"pairs AS (SELECT a.variable, l.lag, b.t, a.x, b.y FROM res a CROSS JOIN (SELECT unnest(range(-{MAX_LAG}, {MAX_LAG} + 1)) AS lag) l JOIN res b ON b.variable = a.variable AND b.t = a.t + l.lag * {PERIOD})"
PEAKS = """pk AS (SELECT u.variable, b.lag AS bl, b.score AS bs, u.lag, u.score FROM b_sup u JOIN b USING (variable) WHERE u.score IS NOT NULL),
pg AS (SELECT variable, any_value(bl) AS best_lag, any_value(bs) AS best_score, avg(score) FILTER (abs(lag - bl) = 1) AS nearby, max(score) FILTER (abs(lag - bl) > 1) AS second, min(lag) FILTER (score >= bs * 0.95) AS lo, max(lag) FILTER (score >= bs * 0.95) AS hi FROM pk GROUP BY variable),
pq AS (SELECT *, coalesce(greatest(0, best_score - nearby), 0) AS sharp, coalesce(greatest(0, least(1, (best_score - second) / best_score)), 0) AS prom FROM pg)"""
LAG_QUALITY = f"(0.7 * prom + 0.3 * least(prom, least(1, sharp / best_score))) * CASE WHEN abs(best_lag) = {MAX_LAG} THEN 0.75 ELSE 1 END"
DIRECTION = "CASE WHEN lo > 1 THEN 'variable_leads_supported' WHEN hi < -1 THEN 'target_leads_supported' WHEN lo = 0 AND hi = 0 THEN 'synchronous' ELSE 'direction_unresolved' END"
GAPS = ("association_score", "lag_quality", "residual_corr")
AHEAD = "(" + " OR ".join(f"coalesce(a.{f} - b.{f} >= 0.05, false)" for f in GAPS) + ") AND NOT (" + " OR ".join(f"coalesce(a.{f} - b.{f} <= -0.05, false)" for f in GAPS) + ")"


def gap_pairs(source: str, name: str) -> str:
    return f"""{name} AS (SELECT x.variable, l.lag, y.t, x.value AS x, y.value AS y FROM {source} x CROSS JOIN (SELECT unnest(range(-{MAX_LAG}, {MAX_LAG} + 1)) AS lag) l
JOIN {source} y ON y.variable = '{TARGET}' AND y.t = x.t + l.lag * {PERIOD} AND y.side = x.side WHERE x.variable <> '{TARGET}' AND x.value IS NOT NULL AND y.value IS NOT NULL)"""


def q(*ctes: str, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


LOAD = "(SELECT min(t) FROM k)"
MASK = f"(t BETWEEN {LOAD} + 7200 AND {LOAD} + 36000 OR t BETWEEN {LOAD} + 72000 AND {LOAD} + 90000)"

#: h without the excluded windows; side counts the windows before, exact and tolerant number the segments.
GAPPED = f"""gx AS (SELECT t, {MASK} AS hit, lag({MASK}) OVER (ORDER BY t) AS was, bool_or(NOT {MASK}) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT t FROM h)),
gt AS (SELECT t, coalesce(was AND before, false) AS start, t - lag(t) OVER (ORDER BY t) AS step FROM gx WHERE NOT hit),
gs AS (SELECT t, sum(start::INT) OVER (ORDER BY t) AS side, sum((step IS NOT NULL AND (step <> {PERIOD} OR start))::INT) OVER (ORDER BY t) AS exact, sum((step IS NOT NULL AND (step > 1.5 * {PERIOD} OR start))::INT) OVER (ORDER BY t) AS tolerant FROM gt),
g AS (SELECT h.t, h.variable, h.value, side, exact, tolerant FROM h JOIN gs USING (t))"""

#: g of the variables that are admitted; nulls are not filled (run <= 0).
SCREEN_FRAME = f"""i0 AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(value IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER z AS t1, count(value) OVER a AS k
 FROM g WINDOW a AS (PARTITION BY variable, exact ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY variable, exact ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i1 AS (SELECT *, row_number() OVER (PARTITION BY variable, exact, k ORDER BY t) - 1 AS run FROM i0),
i2 AS (SELECT t, variable, side, exact, value AS raw, CASE WHEN value IS NOT NULL THEN value WHEN k > 0 AND run <= 0 AND t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM i1),
ok AS (SELECT variable FROM i2 GROUP BY 1 HAVING count(value) > 0 AND (variable IN ('{TARGET}', '{CONTROL}') OR count(raw) / count(*) >= 0.7 AND count(DISTINCT value) > 1)),
hh AS (SELECT t, variable, side, exact, value FROM i2 JOIN ok USING (variable))"""
RANKED = """rf AS (SELECT *, row_number() OVER (ORDER BY final_score DESC NULLS LAST, association_score DESC NULLS LAST, lag_quality DESC NULLS LAST, variable) AS driver_rank, driver_rank AS final_rank, lag AS screening_lag,
 ['pearson', 'spearman'][part % 2 + 1] AS method, lag_quality - 0.5 AS pearson, raw_corr - 0.5 AS spearman, ['variable_leads', 'target_leads'][part % 2 + 1] AS direction, ['priority_review', 'secondary_review', 'risk_limited_review', 'manual_review_only'][part % 4 + 1] AS final_recommendation,
 ['upstream_driver', 'downstream_response', 'formula_or_derived'][part % 3 + 1] AS candidate_class, CASE WHEN part % 5 = 0 THEN part % 997 END AS candidate_priority_rank, CASE WHEN part % 3 = 0 THEN part % 991 END AS candidate_pool_rank FROM used)"""
REASONS = """array_to_string(list_filter([CASE WHEN variable = 'v7' THEN 'target_variable' END, CASE WHEN final_recommendation = 'manual_review_only' THEN 'recommendation_not_eligible' END, CASE WHEN screening_lag <= 0 THEN 'non_positive_screening_lag' END,
 CASE WHEN variable = 'v5' THEN 'control_variable' END, CASE WHEN recommended_use = 'control_variable_reference' THEN 'control_reference' END, CASE WHEN candidate_class IN ('downstream_response', 'formula_or_derived', 'poor_quality') THEN candidate_class END,
 CASE WHEN list_contains(flags, 'strong_formula_leakage') THEN 'strong_formula_leakage' END, CASE WHEN list_contains(flags, 'severe_data_quality') THEN 'severe_data_quality' END, CASE WHEN list_contains(flags, 'target_leads_variable') THEN 'target_leads_variable' END], lambda x: x IS NOT NULL), ';')"""
FOLDS = "f AS (SELECT CAST(p_partkey % 3 AS INT) AS fold, ['M0', 'M1', 'M2'][p_partkey // 3 % 3 + 1] AS model, 1 + p_partkey % 17 / 8.0 AS rmse, p_partkey % 13 / 7.0 AS mae, p_partkey % 11 / 11.0 AS r2 FROM part)"
BASE_FLAGS = ["target_leads_variable", "common_capacity_driver", "strong_formula_leakage", "lag_boundary", "poor_data_quality", "severe_data_quality"]

ORACLE_SQL: dict[str, str] = {
    "exclude_windows_stats": q(K, final=f"SELECT count(*) AS original, count(*) FILTER ({MASK}) AS excluded, count(*) FILTER (NOT {MASK}) AS remaining, round(count(*) FILTER ({MASK}) / count(*), 6) AS ratio, CAST(2 AS BIGINT) AS windows FROM w"),
    "exclude_conditions": q(K, final="SELECT t, round(click, 6) AS click, round(error, 6) AS error FROM w WHERE NOT (coalesce(click > 60, false) OR coalesce(error < 20, false))"),
    "exclusion_gap_starts": q(K, final=f"SELECT t FROM (SELECT t, NOT {MASK} AS kept, lag(NOT {MASK}) OVER (ORDER BY t) AS was, bool_or(NOT {MASK}) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anyk FROM w) WHERE kept AND NOT was AND anyk"),
    "dedupe_keep_last": "SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 AS t, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id DESC) = 1",
    "duplicate_timestamps": "SELECT count(*) - count(DISTINCT l_shipdate) AS duplicate_timestamps FROM lineitem",
    "tercile_segment": q(K, f"q AS (SELECT quantile_cont({CONTROL}, 1/3::DOUBLE) AS q1, quantile_cont({CONTROL}, 2/3::DOUBLE) AS q2 FROM w)", final=f"SELECT t, round({CONTROL}, 6) AS {CONTROL} FROM w, q WHERE {CONTROL} BETWEEN q1 AND q2"),
    "column_admission": q(K, final=f"SELECT variable, round(count(value) / count(*), 6) AS valid_ratio, count(DISTINCT value) AS distinct_values, count(DISTINCT value) > 0 AND (variable = '{TARGET}' OR (count(value) / count(*) >= 0.93 AND count(DISTINCT value) > 1)) AS admitted FROM h GROUP BY 1"),
    "lag_source_mask": q(K, final=f"SELECT t FROM w a WHERE EXISTS (SELECT 1 FROM w b WHERE b.{CONTROL} > 60 AND b.t - a.t BETWEEN {PERIOD} AND 3 * {PERIOD} AND (b.t - a.t) % {PERIOD} = 0)"),
    "sample_period": q(K, NOTNULL, final="SELECT step AS period FROM (SELECT step, count(*) AS n FROM (SELECT t - lag(t) OVER (ORDER BY t) AS step FROM nn) WHERE step > 0 GROUP BY 1) ORDER BY n DESC, step LIMIT 1"),
    "segment_ids_exact": q(K, NOTNULL, segs(f"step <> {PERIOD}"), final="SELECT t, CAST(segment AS BIGINT) AS segment FROM sg"),
    "segment_ids_tolerant": q(K, NOTNULL, segs(f"step > 2.5 * {PERIOD}"), final="SELECT t, CAST(segment AS BIGINT) AS segment FROM sg"),
    "resample_median": q(K, final="SELECT s.t, v.variable, round(m.value, 6) AS value FROM (SELECT unnest(range((SELECT min(t) - min(t) % 86400 + (min(t) % 86400) // 10800 * 10800 FROM h), (SELECT max(t) + 1 FROM h), 10800)) AS t) s CROSS JOIN (SELECT DISTINCT variable FROM h) v LEFT JOIN (SELECT t - t % 86400 + (t % 86400) // 10800 * 10800 AS t, variable, median(value) AS value FROM h GROUP BY 1, 2) m ON m.t = s.t AND m.variable = v.variable"),
    "interpolate_time": q(K, "i0 AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(value IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1, count(value) OVER a AS k FROM h WINDOW a AS (PARTITION BY variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY variable ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", "i1 AS (SELECT *, row_number() OVER (PARTITION BY variable, k ORDER BY t) - 1 AS run FROM i0)", final="SELECT t, variable, round(CASE WHEN value IS NOT NULL THEN value WHEN k > 0 AND run <= 2 AND t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value FROM i1"),
    "ffill_limit": q(K, final="SELECT t, variable, round(last_value(value IGNORE NULLS) OVER (PARTITION BY variable ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM h"),
    "standardize": q(K, final="SELECT t, variable, round((value - avg(value) OVER (PARTITION BY variable)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY variable) > 0 THEN stddev_pop(value) OVER (PARTITION BY variable) ELSE 1 END, 6) AS value FROM h"),
    "lowpass": q(K, "n AS (SELECT variable, t, value, row_number() OVER (PARTITION BY variable ORDER BY t) AS i FROM h WHERE value IS NOT NULL)", "f AS (SELECT variable, t, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.variable, n.t, n.i, f.y + (1 - exp(-((n.t - f.t) / 60.0) / 90.0)) * (n.value - f.y) FROM f JOIN n ON n.variable = f.variable AND n.i = f.i + 1)", final="SELECT h.t, h.variable, round(f.y, 6) AS value FROM h LEFT JOIN f ON f.t = h.t AND f.variable = h.variable"),
    "detrend_centered": q(K, final="SELECT t, variable, round(CASE WHEN count(value) OVER z >= 2 THEN value - avg(value) OVER z END, 6) AS value FROM h WINDOW z AS (PARTITION BY variable ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)"),
    "detrend_trailing": q(K, final="SELECT t, variable, round(CASE WHEN count(value) OVER z >= 2 THEN value - avg(value) OVER z END, 6) AS value FROM h WINDOW z AS (PARTITION BY variable ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"),
    "diff_segment": q(K, NOTNULL, segs(f"step <> {PERIOD}"), final="SELECT h.t, h.variable, round(value - lag(value) OVER (PARTITION BY h.variable, segment ORDER BY h.t), 6) AS value FROM h JOIN sg ON sg.t = h.t"),
    "diff_interval": q(K, NOTNULL, segs(f"step > 1.5 * {PERIOD}"), final="SELECT h.t, h.variable, round(value - lag(value, 2) OVER (PARTITION BY h.variable, segment ORDER BY h.t), 6) AS value FROM h JOIN sg ON sg.t = h.t"),
    "lag_pearson": q(K, PAIRS, final=f"SELECT variable, CAST(lag AS INT) AS lag, count(*) AS n, round({corr('x', 'y')}, 6) AS pearson FROM pairs GROUP BY 1, 2"),
    "lag_spearman": q(K, PAIRS, S, final="SELECT variable, CAST(lag AS INT) AS lag, n, round(spearman, 6) AS spearman FROM s"),
    "bh_adjust": q(K, PAIRS, S, "p AS (SELECT variable, lag, 1 - abs(pearson) AS p FROM s)", "rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)", final="SELECT variable, CAST(lag AS INT) AS lag, round(p, 6) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM rk"),
    "best_lag": q(K, PAIRS, S, B, final="SELECT variable, CAST(lag AS INT) AS lag, n, round(score, 6) AS score, method, CASE WHEN lag > 0 THEN 'variable_leads' WHEN lag < 0 THEN 'target_leads' ELSE 'synchronous' END AS direction FROM b"),
    "lag_peak_quality": q(
        K, PAIRS, S, B, PEAKS,
        final=f"SELECT variable, CAST(best_lag AS INT) AS best_lag, round(best_score, 6) AS best_score, round(prom, 6) AS peak_prominence, round({LAG_QUALITY}, 6) AS lag_quality, {DIRECTION} AS temporal_direction_status FROM pq",
    ),
    "diagnostics": q(K, DIAG, final="SELECT variable, round(missing_rate, 6) AS missing_rate, longest_missing_run, constant_run_max, abnormal_jump_count, round(abnormal_jump_ratio, 6) AS abnormal_jump_ratio, round(robust_outlier_ratio, 6) AS robust_outlier_ratio, round(saturation_ratio, 6) AS saturation_ratio FROM diag"),
    "data_quality_score": q(K, DIAG, final="SELECT variable, round(exp(-ln(2) * (missing_rate / 0.2 + saturation_ratio / 0.2 + abnormal_jump_ratio / 0.01 + robust_outlier_ratio / 0.01) / 4), 6) AS data_quality_score FROM diag"),
    "residual_corr": q(
        K, JOINT, "fit AS (SELECT variable, regr_slope(x, z) AS bx, regr_intercept(x, z) AS ax, regr_slope(y, z) AS cy, regr_intercept(y, z) AS ay, count(*) AS m, avg(z) AS mz, avg(z * z) AS mzz FROM c GROUP BY 1)",
        "res AS (SELECT t, c.variable, x - ax - bx * z AS x, y - ay - cy * z AS y FROM c JOIN fit USING (variable))", RESPAIRS, S, B, PEAKS,
        final=f"SELECT variable, 'ok' AS residual_status, 1 AS control_count, 2 AS control_matrix_rank, CAST(lag AS INT) AS residual_lag, round(score, 6) AS residual_corr, method AS residual_method, n AS residual_n, round({LAG_QUALITY}, 6) AS residual_lag_quality, round(sqrt((1 + mzz + sqrt((1 + mzz) * (1 + mzz) - 4 * (mzz - mz * mz))) / (1 + mzz - sqrt((1 + mzz) * (1 + mzz) - 4 * (mzz - mz * mz)))), 4) AS condition_number FROM b JOIN pq USING (variable) JOIN fit USING (variable) UNION ALL SELECT '{CONTROL}', 'control_reference_not_residualized', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    ),
    "residual_corr_many_controls": q(
        K, f"c AS (SELECT x.t, x.variable, x.value AS x, y.value AS y, z.value AS z, s.value AS s FROM h x JOIN h y ON y.t = x.t AND y.variable = '{TARGET}' JOIN h z ON z.t = x.t AND z.variable = '{CONTROL}' JOIN h s ON s.t = x.t AND s.variable = 'signup' WHERE x.variable NOT IN ('{TARGET}', '{CONTROL}', 'signup') AND x.value IS NOT NULL AND y.value IS NOT NULL AND z.value IS NOT NULL AND s.value IS NOT NULL)",
        "mom AS (SELECT variable, var_pop(z) AS zz, var_pop(s) AS ss, covar_pop(z, s) AS zs, covar_pop(x, z) AS xz, covar_pop(x, s) AS xs, covar_pop(y, z) AS yz, covar_pop(y, s) AS ys, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(s) AS ms FROM c GROUP BY 1)",
        "fit AS (SELECT *, (xz * ss - xs * zs) / (zz * ss - zs * zs) AS b1, (xs * zz - xz * zs) / (zz * ss - zs * zs) AS b2, (yz * ss - ys * zs) / (zz * ss - zs * zs) AS d1, (ys * zz - yz * zs) / (zz * ss - zs * zs) AS d2 FROM mom)",
        "res AS (SELECT t, c.variable, x - mx - b1 * (z - mz) - b2 * (s - ms) AS x, y - my - d1 * (z - mz) - d2 * (s - ms) AS y FROM c JOIN fit USING (variable))", RESPAIRS, S, B,
        final=f"SELECT variable, 'ok' AS residual_status, 3 AS control_matrix_rank, CAST(lag AS INT) AS residual_lag, round(score, 6) AS residual_corr, n AS residual_n FROM b UNION ALL SELECT unnest(['{CONTROL}', 'signup']), 'control_reference_not_residualized', NULL, NULL, NULL, NULL",
    ),
    "regime_scores": q(K, PAIRS, REG, final="SELECT variable, regime, CAST(lag AS INT) AS lag, round(score, 6) AS score, round(signed, 6) AS signed_corr, n FROM rbest"),
    "regime_robustness": q(
        K, PAIRS, REG,
        "g AS (SELECT variable, count(DISTINCT regime) AS k, min(score) AS lo, max(score) AS hi, abs(sum(signed)) AS net, sum(abs(signed)) AS gross, stddev_pop(lag) AS sd, max(signed) > 0 AND min(signed) < 0 AS rev FROM rbest GROUP BY 1)",
        final=f"SELECT variable, k AS regime_count, round(lo / hi, 6) AS regime_strength_consistency, round(least(1, net / gross), 6) AS regime_sign_consistency, round(greatest(0, 1 - sd / {MAX_LAG}.0), 6) AS regime_lag_consistency, round(k / 3 * least(1, net / gross) * (0.6 * lo / hi + 0.4 * greatest(0, 1 - sd / {MAX_LAG}.0)), 6) AS regime_stability_final, CASE WHEN k = 3 THEN 'full_coverage' ELSE 'partial_coverage' END AS regime_evidence_status, rev AS regime_sign_reversal_flag FROM g",
    ),
    "rolling_corr": q(K, PAIRS, S, B, ROLL, final="SELECT variable, t, round(r, 6) AS r FROM roll"),
    "rolling_stability": q(K, PAIRS, S, B, ROLL, final="SELECT variable, round(median(r), 6) AS rolling_corr_median, round(greatest(avg(CASE WHEN r >= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN r < 0 THEN 1.0 ELSE 0 END)), 6) AS rolling_sign_consistency, count(*) AS valid_window_count, round(greatest(0, least(1, median(abs(r)) * greatest(avg(CASE WHEN r >= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN r < 0 THEN 1.0 ELSE 0 END)) * (1 - least(1, quantile_cont(r, 0.75) - quantile_cont(r, 0.25))))), 6) AS rolling_stability FROM roll GROUP BY 1"),
    "innovation": q(
        K, GAPPED, gap_pairs("g", "pairs"), S, B,
        "d AS (SELECT t, variable, side, value - lag(value) OVER (PARTITION BY variable, exact ORDER BY t) AS value FROM g)",
        gap_pairs("d", "dall"), "dp AS (SELECT a.* FROM dall a JOIN b ON b.variable = a.variable AND abs(b.lag - a.lag) <= 2)",
        scores("variable, lag", "dp", "ds"), best("variable", "ds", "db"),
        "st AS (SELECT b.variable, b.lag AS raw_lag, db.lag AS near_lag, db.score, CASE WHEN db.lag IS NULL THEN 'not_computed' WHEN NOT (abs(db.lag - b.lag) <= 2 AND sign(db.lag) = sign(b.lag)) THEN 'innovation_lag_conflict' WHEN sign(db.signed) <> sign(b.signed) THEN 'innovation_sign_conflict' ELSE 'innovation_verified' END AS status FROM b LEFT JOIN db USING (variable))",
        final="SELECT variable, CAST(raw_lag AS INT) AS raw_lag, CAST(near_lag AS INT) AS innovation_lag, round(CASE WHEN status = 'innovation_verified' THEN score END, 6) AS innovation_score, status AS innovation_status FROM st",
    ),
    "lag_scores_with_gaps": q(K, GAPPED, gap_pairs("g", "pairs"), S, final="SELECT variable, CAST(lag AS INT) AS lag, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM s"),
    "lag_scores_by_windows": q(K, PAIRS, S, final="SELECT variable, CAST(lag AS INT) AS lag, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM s"),
    "segments_with_gaps": q(K, GAPPED, final="SELECT DISTINCT t, CAST(exact AS BIGINT) AS exact, CAST(tolerant AS BIGINT) AS tolerant FROM g"),
    "lowpass_with_gaps": q(K, GAPPED, "n AS (SELECT variable, tolerant, t, value, row_number() OVER (PARTITION BY variable, tolerant ORDER BY t) AS i FROM g WHERE value IS NOT NULL)", "f AS (SELECT variable, tolerant, t, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.variable, n.tolerant, n.t, n.i, f.y + (1 - exp(-((n.t - f.t) / 60.0) / 90.0)) * (n.value - f.y) FROM f JOIN n ON n.variable = f.variable AND n.tolerant = f.tolerant AND n.i = f.i + 1)", final="SELECT g.t, g.variable, round(f.y, 6) AS value FROM g LEFT JOIN f ON f.t = g.t AND f.variable = g.variable"),
    "resample_segments": q(K, GAPPED, "lo AS (SELECT exact, min(t) AS lo, max(t) AS hi FROM g GROUP BY 1)", "m AS (SELECT exact, variable, lo + (t - lo) // 10800 * 10800 AS t, median(value) AS value FROM g JOIN lo USING (exact) GROUP BY 1, 2, 3)", "sp AS (SELECT exact, unnest(range(lo, hi + 1, 10800)) AS t FROM lo)", final=f"SELECT CAST(sp.exact AS BIGINT) AS segment, sp.t, v.variable, round(m.value, 6) AS value FROM sp CROSS JOIN (SELECT unnest({VARIABLES}) AS variable) v LEFT JOIN m ON m.exact = sp.exact AND m.t = sp.t AND m.variable = v.variable"),
    "lag_p_and_q_values": q(
        K, PAIRS, S, "k2 AS (SELECT variable, lag, n - 2 AS v, unnest(['pearson', 'spearman']) AS kind, unnest([pearson, spearman]) AS r FROM s)",
        "a AS (SELECT *, sqrt(1 - r * r) AS cs, abs(r) AS sn, atan(abs(r) / sqrt(1 - r * r)) AS th FROM k2 WHERE r IS NOT NULL)",
        # The distribution of Student's t as a finite sum, by the parity of the degrees of freedom.
        "p AS (SELECT variable, lag, kind, 1 - CASE WHEN v % 2 = 0 THEN sn * list_sum(list_transform(range(0, CAST(v // 2 AS BIGINT)), lambda i: exp(2 * i * ln(cs) + lgamma(i + 0.5) - lgamma(i + 1.0) - lgamma(0.5)))) ELSE 2 / pi() * (th + sn * cs * list_sum(list_transform(range(0, CAST((v - 1) // 2 AS BIGINT)), lambda i: exp(2 * i * ln(cs) + lgamma(0.5) + lgamma(i + 1.0) - ln(2.0) - lgamma(i + 1.5))))) END AS p FROM a)",
        "rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)",
        "qq AS (SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk)",
        final="SELECT variable, CAST(lag AS INT) AS lag, round(max(p) FILTER (kind = 'pearson'), 6) AS pearson_p, round(max(p) FILTER (kind = 'spearman'), 6) AS spearman_p, round(max(q) FILTER (kind = 'pearson'), 6) AS pearson_q, round(max(q) FILTER (kind = 'spearman'), 6) AS spearman_q FROM qq GROUP BY 1, 2",
    ),
    "redundant_pairs_aligned": q(
        K, "l AS (SELECT * FROM (VALUES ('click', 1), ('error', 2), ('signup', 2)) v(variable, lag))", f"mv AS (SELECT h.t + l.lag * {PERIOD} AS t, h.variable, h.value FROM h JOIN l USING (variable) WHERE h.value IS NOT NULL AND h.t + l.lag * {PERIOD} IN (SELECT t FROM h))",
        final=f"SELECT x.variable AS a, y.variable AS b, count(*) AS n, round({corr('x.value', 'y.value')}, 6) AS r, coalesce(count(*) >= 30 AND abs({corr('x.value', 'y.value')}) >= 0.01, false) AS redundant FROM mv x JOIN mv y ON x.t = y.t AND x.variable < y.variable GROUP BY 1, 2",
    ),
    "redundant_variables": q(
        R, "e AS (SELECT *, part // 3 AS g FROM r)",
        f"w AS (SELECT a.part, bool_and({AHEAD}) AS first FROM e a JOIN e b ON a.g = b.g AND a.part <> b.part GROUP BY 1)",
        final="SELECT part, count(*) OVER (PARTITION BY g) > 1 AND NOT coalesce(first, false) AS redundant FROM e LEFT JOIN w USING (part)",
    ),
    "redundant_pairs": q(K, final=f"SELECT x.variable AS a, y.variable AS b, count(*) AS n, round({corr('x.value', 'y.value')}, 6) AS r, coalesce(count(*) >= 30 AND abs({corr('x.value', 'y.value')}) >= 0.995, false) AS redundant FROM h x JOIN h y ON x.t = y.t AND x.variable < y.variable WHERE '{TARGET}' NOT IN (x.variable, y.variable) AND x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2"),
    "score_components": q(R, SCORED, final=f"SELECT part, {r6('base_score', 'support_bonus_rate', 'stability_support', 'evidence_score', 'final_score')} FROM scored"),
    "risk_flags": q(R, SCORED, FLAGGED, final="SELECT part, risk_flags, CAST(risk_count AS INT) AS risk_count, CAST(strong_risk_count AS INT) AS strong_risk_count, risk_level FROM flagged"),
    "grade_use": q(R, SCORED, FLAGGED, final="SELECT part, candidate_grade, recommended_use FROM used"),
    "risk_flag_filter": q(R, SCORED, FLAGGED, final="SELECT part FROM flagged WHERE contains(risk_flags, 'lag_boundary') OR contains(risk_flags, 'formula_like')"),
    "control_reference": q(R, final="SELECT part, CASE WHEN upper(regexp_extract(variable, '[._:-]([SsMm][VvPp])$', 1)) = 'MV' THEN 'pid_output' WHEN upper(regexp_extract(variable, '[._:-]([SsMm][VvPp])$', 1)) IN ('SP', 'SV') THEN 'pid_setpoint' END AS reference FROM r"),
    "initial_order": q(R, SCORED, final="SELECT part, row_number() OVER (ORDER BY final_score DESC NULLS LAST, association_score DESC NULLS LAST, lag_quality DESC NULLS LAST, variable) AS driver_rank FROM scored"),
    "recommended_pool": q(R, SCORED, FLAGGED, POOL, final="SELECT part, candidate_source, selected_by_raw, selected_by_residual, common_capacity_candidate_flag, candidate_pool_rank FROM pool"),
    "priority_tiers": q(R, SCORED, FLAGGED, POOL, TIERS, final="SELECT part, status AS load_adjusted_relation_status, tier AS candidate_priority_tier, round(pscore, 6) AS candidate_priority_score, row_number() OVER (ORDER BY tier, pscore DESC NULLS LAST, residual_n DESC NULLS LAST, candidate_pool_rank, variable) AS candidate_priority_rank FROM t3"),
    "review_tier": q(R, SCORED, FLAGGED, final="SELECT part, CASE WHEN recommended_use IN ('capacity_driven', 'formula_coupled_reference', 'unstable_candidate', 'control_variable_reference') THEN 4 WHEN candidate_grade = 'A' AND recommended_use IN ('strong_screening_candidate', 'prediction_candidate') AND risk_level IN ('none', 'weak', '') THEN 1 WHEN candidate_grade IN ('A', 'B') AND risk_level IN ('none', 'weak', 'medium', '') THEN 2 WHEN final_score >= 0.45 THEN 3 ELSE 5 END AS review_priority FROM used"),
    "review_decision": q(R, SCORED, FLAGGED, final=f"SELECT part, CASE WHEN conditional_status = 'high_collinearity_risk' AND predictive_contribution > 0 THEN 'manual_review_only' WHEN {LIMITED} AND NOT starts_with(conditional_status, 'ok') THEN 'risk_limited_review' WHEN NOT starts_with(conditional_status, 'ok') THEN 'insufficient_evidence' WHEN risk_level IN ('high', 'strong') THEN 'manual_review_only' WHEN {LIMITED} THEN 'risk_limited_review' WHEN conditional_q <= 0.05 AND predictive_contribution >= 0.05 THEN 'priority_review' WHEN conditional_q <= 0.1 AND predictive_contribution >= 0.02 THEN 'secondary_review' ELSE 'not_recommended' END AS decision FROM used"),
    "evidence_score": q(
        R, SCORED, FLAGGED,
        "e AS (SELECT *, CASE candidate_grade WHEN 'A' THEN 2.0 WHEN 'B' THEN 1.5 WHEN 'C' THEN 1.0 WHEN 'D' THEN 0.5 ELSE 0 END + CASE WHEN NOT starts_with(conditional_status, 'ok') OR conditional_q IS NULL THEN 0 WHEN contains(conditional_status, 'fallback') THEN CASE WHEN conditional_q <= 0.1 THEN 0.4 ELSE 0 END WHEN conditional_q <= 0.05 THEN 2.0 WHEN conditional_q <= 0.1 THEN 1.0 ELSE 0 END + CASE WHEN predictive_contribution > 0 THEN CASE WHEN conditional_status = 'high_collinearity_risk' THEN 0.3 ELSE 0.5 END ELSE 0 END + CASE WHEN granger_q <= 0.05 THEN 0.75 WHEN granger_q <= 0.1 THEN 0.4 ELSE 0 END + CASE WHEN model_lift >= 0.05 THEN 0.75 WHEN model_lift >= 0.01 THEN 0.4 ELSE 0 END + CASE WHEN rolling_stability >= 0.7 THEN 0.75 WHEN rolling_stability >= 0.5 THEN 0.4 ELSE 0 END + CASE WHEN sign_consistency >= 0.8 THEN 0.3 ELSE 0 END + CASE WHEN importance_rank <= 5 THEN 0.75 WHEN importance_rank <= 10 THEN 0.4 ELSE 0 END AS es FROM used)",
        final="SELECT part, round(CAST(es AS DOUBLE), 6) AS points, CASE WHEN risk_level = 'strong' THEN 'risk_limited' WHEN round(es, 9) >= 4 AND risk_level IN ('', 'none', 'weak') THEN 'strong' WHEN round(es, 9) >= 2.5 THEN 'moderate' WHEN round(es, 9) >= 1 THEN 'weak_or_incomplete' WHEN regexp_matches(conditional_status, 'insufficient|skipped') THEN 'insufficient' ELSE 'not_supported' END AS evidence_level FROM e",
    ),
    "evidence_matrix": q(R, final="SELECT part, CASE WHEN granger_q <= 0.1 THEN 'supported' ELSE 'missing' END AS granger, 'not_computed' AS model, CASE WHEN lift_status = 'ok' THEN lift_status ELSE 'missing' END AS lift FROM r"),
    "validation_summary": q(R, "m AS (SELECT part, CASE part % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'zero' WHEN 2 THEN 'missing' ELSE 'not_run' END AS a, CASE part % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'no_support' ELSE 'not_run' END AS b, CASE part % 2 WHEN 0 THEN 'supported' ELSE 'not_run' END AS c FROM r)", "c AS (SELECT part, list_value(a, b, c) AS l FROM m)", "n AS (SELECT part, len(list_filter(l, lambda x: x <> 'not_run')) AS ran, len(list_filter(l, lambda x: x = 'supported')) AS sup, len(list_filter(l, lambda x: x IN ('zero', 'no_support'))) AS weak, len(list_filter(l, lambda x: x IN ('zero', 'no_support', 'missing'))) AS lim FROM c)", "v AS (SELECT part, CASE WHEN ran = 0 THEN 'not_run' WHEN sup = 0 THEN CASE WHEN weak > 0 THEN 'limited' ELSE 'not_computed' END WHEN lim > 0 THEN 'limited' WHEN sup >= 2 THEN 'supported' ELSE 'limited' END AS validation_status FROM n)", final="SELECT part, validation_status, CASE validation_status WHEN 'supported' THEN 'consistent' WHEN 'limited' THEN 'partial' ELSE validation_status END AS evidence_consistency FROM v"),
    "final_review": q(R, SCORED, "d AS (SELECT *, ['priority_review', 'secondary_review', 'manual_review_only', 'not_recommended', 'other'][part % 5 + 1] AS decision, ['high', 'medium', 'low'][part % 3 + 1] AS data_priority FROM scored)", final="SELECT part, row_number() OVER (ORDER BY CASE decision WHEN 'priority_review' THEN 1 WHEN 'secondary_review' THEN 3 WHEN 'manual_review_only' THEN 5 WHEN 'not_recommended' THEN 8 ELSE 99 END, CASE data_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, evidence_score DESC NULLS LAST, final_score DESC NULLS LAST, variable) AS final_rank FROM d"),
    "fill_missing_join": "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END), ''), o_orderpriority) AS label FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON o_custkey = c_custkey",
    "branch_comparison": q(R, "a AS (SELECT variable, row_number() OVER (ORDER BY raw_corr DESC, part) AS rank, lag, raw_corr AS score FROM r WHERE raw_corr > 0 OR lag_quality <= 0.1)", "b AS (SELECT variable, row_number() OVER (ORDER BY lag_quality DESC, part) AS rank, -lag AS lag, lag_quality AS score FROM r WHERE lag_quality > 0.1)", final="SELECT variable, CASE WHEN a.rank IS NULL THEN 'processed_only' WHEN b.rank IS NULL THEN 'raw_only' ELSE 'both' END AS presence, round(b.score - a.score, 6) AS score_delta, CAST(b.lag - a.lag AS DOUBLE) AS lag_delta, CAST(b.rank - a.rank AS DOUBLE) AS rank_delta, coalesce(sign(a.lag) <> sign(b.lag), false) AS direction_changed, coalesce(a.rank <= 20, false) AS in_raw_top, coalesce(b.rank <= 20, false) AS in_processed_top FROM a FULL OUTER JOIN b USING (variable)"),
    "occurrence_join": "WITH a AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS i, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS j, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'N') SELECT a.k, CAST(a.n AS INT) AS occurrence, i, CAST(j AS DOUBLE) AS j FROM a LEFT JOIN b ON a.k = b.k AND a.n = b.n",
    "topk_overlap": q(R, "a AS (SELECT variable, row_number() OVER (ORDER BY raw_corr DESC, part) AS rank FROM r)", "b AS (SELECT variable, row_number() OVER (ORDER BY lag_quality DESC, part) AS rank FROM r)", final="SELECT CAST(k AS INT) AS k, count(*) FILTER (a.rank <= k AND b.rank <= k) AS shared, count(*) FILTER (a.rank > k AND b.rank <= k) AS entered, count(*) FILTER (a.rank <= k AND b.rank > k) AS dropped FROM a JOIN b USING (variable), (SELECT unnest([10, 20, 30]) AS k) GROUP BY 1"),
    "expanding_splits": q(K, "n AS (SELECT count(*) AS n FROM w)", "f AS (SELECT fold, n, n // 4 AS size, n - (3 - fold) * (n // 4) AS test, n - (3 - fold) * (n // 4) - 2 AS v1 FROM n, (SELECT unnest([0, 1, 2]) AS fold))", "g AS (SELECT *, v1 - greatest(30, CAST(floor(v1 * 0.15) AS BIGINT)) AS v0 FROM f)", final="SELECT CAST(fold AS INT) AS fold, p AS partition, CAST(CASE p WHEN 'train' THEN 0 WHEN 'validation' THEN v0 ELSE test END AS BIGINT) AS start, CAST(CASE p WHEN 'train' THEN v0 - 2 WHEN 'validation' THEN v1 ELSE CASE WHEN fold = 2 THEN n ELSE test + size END END AS BIGINT) AS stop FROM g, (SELECT unnest(['train', 'validation', 'test']) AS p)"),
    "fold_context": q(K, "n AS (SELECT count(*) AS n FROM w)", "f AS (SELECT fold, n, n // 4 AS size, n - (3 - fold) * (n // 4) AS test, n - (3 - fold) * (n // 4) - 2 AS v1 FROM n, (SELECT unnest([0, 1, 2]) AS fold))", "g AS (SELECT *, v1 - greatest(30, CAST(floor(v1 * 0.15) AS BIGINT)) AS v0 FROM f)", "s AS (SELECT CAST(fold AS INT) AS fold, p AS partition, CASE p WHEN 'train' THEN 0 WHEN 'validation' THEN v0 ELSE test END AS a, CASE p WHEN 'train' THEN v0 - 2 WHEN 'validation' THEN v1 ELSE CASE WHEN fold = 2 THEN n ELSE test + size END END AS b FROM g, (SELECT unnest(['train', 'validation', 'test']) AS p))", "i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM w)", final="SELECT fold, partition, min(t) AS start, max(t) AS stop, count(*) AS rows, round((max(t) - min(t)) / 60.0, 6) AS minutes FROM s JOIN i ON i >= a AND i < b GROUP BY 1, 2"),
    "lag_features": q(K, final=f"SELECT w.t, round(a.{TARGET}, 6) AS {TARGET}__lag_1, round(b.click, 6) AS click__lag_2, round(c.view, 6) AS view__lag_5 FROM w LEFT JOIN w a ON a.t = w.t - {PERIOD} LEFT JOIN w b ON b.t = w.t - 2 * {PERIOD} LEFT JOIN w c ON c.t = w.t - 5 * {PERIOD}"),
    "fold_errors": q(K, f"p AS (SELECT CAST(w.t // 604800 % 3 AS INT) AS fold, w.{TARGET} AS actual, a.{TARGET} AS predicted FROM w JOIN w a ON a.t = w.t - {PERIOD} WHERE w.{TARGET} IS NOT NULL AND a.{TARGET} IS NOT NULL)", final="SELECT fold, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 6) AS r2, count(*) AS rows FROM p GROUP BY 1"),
    "uplift_summary": "WITH m AS (SELECT p_partkey % 50 AS g, (p_partkey * 7 % 41) / 2.0 - 8 AS r, (p_partkey * 11 % 37) / 2.0 - 7 AS a FROM part), s AS (SELECT concat('v', g) AS variable, count(*) AS fold_count, count(*) FILTER (r > 0) AS pos, count(*) FILTER (r < 0) AS neg, count(*) FILTER (a > 0) AS pos_mae, median(r) AS mr, median(a) AS mm, min(r) AS worst, count(*) FILTER (r > 0) / count(*) AS ratio FROM m GROUP BY g) SELECT variable, fold_count, pos AS positive_rmse_fold_count, pos_mae AS positive_mae_fold_count, round(ratio, 6) AS positive_rmse_fold_ratio, round(mr, 6) AS median_rmse_improvement_pct, round(mm, 6) AS median_mae_improvement_pct, round(worst, 6) AS worst_fold_rmse_improvement_pct, CASE WHEN pos > 0 AND neg > 0 AND worst < 0 THEN 'unstable_out_of_time' WHEN fold_count >= 2 AND ratio >= 0.67 AND mr > 0 AND mm >= 0 THEN 'validated_incremental_signal' WHEN mr > 0 THEN 'weak_incremental_value' ELSE 'redundant_with_baseline' END AS validation_status FROM s",
    "variable_importance": "WITH f AS (SELECT concat('v', p_partkey % 40) AS variable, (p_partkey * 13 % 1009) / 1009.0 AS importance FROM part), g AS (SELECT variable, sum(importance) AS total, max(importance) AS top, count(*) AS n FROM f GROUP BY 1) SELECT variable, round(total, 6) AS total_importance, round(top, 6) AS max_importance, n AS feature_count, CAST(row_number() OVER (ORDER BY round(total, 9) DESC, top DESC, variable) AS INT) AS importance_rank FROM g",
    "trend_stats": q(K, final="SELECT variable, count(*) AS rows, count(value) AS known, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(median(value), 6) AS median, round(max(value) - min(value), 6) AS span, round(count(value) / count(*), 6) AS known_ratio FROM h GROUP BY 1"),
    "histogram": q(K, "s AS (SELECT variable, min(value) AS lo, max(value) AS hi, least(12, ceil(sqrt(count(value)))) AS bins FROM h WHERE value IS NOT NULL GROUP BY 1)", final="SELECT variable, CAST(least(bins - 1, floor((value - lo) / ((hi - lo) / bins))) AS BIGINT) AS bin, count(*) AS n FROM h JOIN s USING (variable) WHERE value IS NOT NULL GROUP BY 1, 2"),
    "downsample": q(K, "i AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM w)", final="SELECT t, round(purchase, 6) AS purchase FROM i WHERE i IN (SELECT DISTINCT j * ((SELECT count(*) FROM w) - 1) // 99 FROM (SELECT unnest(range(100)) AS j))"),
    "scatter_matrix": q(K, final="SELECT t, 'click' AS x_name, 'purchase' AS y_name, round(click, 6) AS x, round(purchase, 6) AS y FROM w WHERE click IS NOT NULL AND purchase IS NOT NULL UNION ALL SELECT t, 'click', 'view', round(click, 6), round(view, 6) FROM w WHERE click IS NOT NULL AND view IS NOT NULL"),
    "lag_profile": q(K, PAIRS, S, final="SELECT CAST(lag AS INT) AS lag, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM s WHERE variable = 'click'"),
    "normal_curve": q(K, "s AS (SELECT variable, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM h WHERE value IS NOT NULL GROUP BY 1)", "x AS (SELECT variable, i, lo + (hi - lo) * i / 40 AS x, m, s FROM s, (SELECT unnest(range(41)) AS i) WHERE s > 0 AND lo < hi)", final="SELECT variable, CAST(i AS INT) AS i, round(x, 6) AS x, round(exp(-0.5 * ((x - m) / s) * ((x - m) / s)), 6) AS y FROM x"),
    "candidate_exclusions": q(R, SCORED, FLAGGED, RANKED, final=f"SELECT part, {REASONS} AS reasons FROM rf"),
    "candidate_pool": q(
        R, SCORED, FLAGGED, RANKED, f"ex AS (SELECT *, {REASONS} AS reasons FROM rf)",
        "au AS (SELECT variable, row_number() OVER (ORDER BY candidate_priority_rank NULLS LAST, final_rank NULLS LAST, candidate_pool_rank NULLS LAST, variable) AS a FROM ex WHERE reasons = '' QUALIFY a <= 6)",
        "fo AS (SELECT * FROM (VALUES ('v2', 0), ('v30', 1), ('absent', 2)) f(variable, f))",
        "al AS (SELECT coalesce(au.variable, fo.variable) AS variable, a, f FROM au FULL OUTER JOIN fo USING (variable))",
        final="SELECT al.variable, CAST(row_number() OVER (ORDER BY a NULLS LAST, f NULLS LAST, al.variable) AS INT) AS candidate_order, CASE WHEN a IS NULL THEN 'whitelist' WHEN f IS NULL THEN 'final_review' ELSE 'final_review+whitelist' END AS selection_source, f IS NOT NULL AS force_included, coalesce(reasons = '', false) AS auto_eligible, reasons AS auto_exclusion_reasons FROM al LEFT JOIN ex USING (variable)",
    ),
    "review_pool": q(R, SCORED, FLAGGED, RANKED, "p AS (SELECT variable, 'initial_screening' AS candidate_source, driver_rank AS source_rank, driver_rank AS o FROM rf WHERE driver_rank <= 12 UNION ALL SELECT m.variable, 'manual_include', rf.driver_rank, 100 + m.i FROM (VALUES ('v4', 0), ('v6', 1), ('absent', 2)) m(variable, i) LEFT JOIN rf USING (variable) WHERE coalesce(rf.driver_rank, 99) > 12)", final="SELECT variable, candidate_source, CAST(source_rank AS INT) AS source_rank, CAST(row_number() OVER (ORDER BY o) AS INT) AS pool_order FROM p"),
    "secondary_variables": q(R, SCORED, FLAGGED, RANKED, "p AS (SELECT variable, row_number() OVER (ORDER BY final_score DESC NULLS LAST, driver_rank) AS place FROM rf QUALIFY place <= 15 UNION ALL SELECT * FROM (VALUES ('v4', 16), ('v9', 17), ('v4', 18), ('other', 19)) m(variable, place))", final="SELECT variable, row_number() OVER (ORDER BY min(place)) AS place FROM p GROUP BY variable"),
    "discovered_candidates": q(
        R, SCORED, FLAGGED, RANKED, "fi AS (SELECT concat('v', p_partkey % 40) AS variable, CAST(p_partkey % 13 AS INT) AS lag, max((p_partkey * 13 % 1009) / 1009.0) AS importance FROM part GROUP BY 1, 2)",
        "tp AS (SELECT *, concat(variable, '__lag_', lag) AS feature, row_number() OVER (ORDER BY importance DESC, concat(variable, '__lag_', lag)) AS ir FROM fi QUALIFY ir <= 50)",
        "gr AS (SELECT variable, arg_min(feature, ir) AS best_model_feature, arg_min(lag, ir) AS best_model_lag, max(importance) AS max_importance, min(ir) AS importance_rank, count(*) AS model_feature_count, count(DISTINCT lag) AS nearby_lag_count FROM tp GROUP BY 1)",
        "jn AS (SELECT gr.*, coalesce(rf.driver_rank <= 30, false) AS in_top, coalesce(rf.risk_flags, '') AS fl FROM gr LEFT JOIN rf USING (variable))",
        "rs AS (SELECT *, list_filter([CASE WHEN NOT in_top THEN 'model_only_signal' END, CASE WHEN model_feature_count >= 3 THEN 'multi_lag_model_signal' END, CASE WHEN best_model_lag >= 10 THEN 'model_lag_boundary_risk' END, CASE WHEN best_model_lag = 0 THEN 'synchronous_or_leakage_risk' END, CASE WHEN contains(fl, 'lag_boundary') THEN 'screening_lag_boundary_risk' END, CASE WHEN contains(fl, 'target_leads_variable') THEN 'target_lead_risk' END, CASE WHEN contains(fl, 'unstable_over_time') OR contains(fl, 'unstable_across_regimes') THEN 'stability_risk' END], lambda x: x IS NOT NULL) AS l FROM jn)",
        final="SELECT variable, best_model_feature, best_model_lag, round(max_importance, 6) AS max_importance, CAST(importance_rank AS INT) AS importance_rank, model_feature_count, nearby_lag_count, in_top AS in_screening_top_n, CASE WHEN len(l) > 0 THEN array_to_string(l, ';') ELSE 'model_supported_screening_candidate' END AS discovery_reason FROM rs",
    ),
    "discovery_candidates": q(R, SCORED, FLAGGED, RANKED, final="SELECT variable, CAST(driver_rank AS INT) AS source_rank, concat('model:', risk_level) AS discovery_reason FROM rf WHERE driver_rank BETWEEN 21 AND 25"),
    "ranked_lag_merge": q(R, SCORED, FLAGGED, final="SELECT part, lag, round(CASE WHEN part % 2 = 0 THEN final_score * 2 ELSE final_score END, 6) AS final_score, 'kept' AS note, risk_level FROM used"),
    "enhanced_summary": q(R, SCORED, FLAGGED, RANKED, "a AS (SELECT * FROM rf WHERE final_score > 0.2)", "b AS (SELECT * FROM rf WHERE lift_status = 'ok')", "c AS (SELECT * FROM rf WHERE rolling_stability IS NOT NULL)", "n AS (SELECT variable FROM a UNION SELECT variable FROM b UNION SELECT variable FROM c)", final="SELECT n.variable, round(a.final_score, 6) AS final_score, a.lag, a.direction, a.risk_flags, a.recommended_use, b.lift_status AS status, round(b.model_lift, 6) AS model_lift, round(b.raw_corr, 6) AS ar_baseline_rmse, round(b.lag_quality, 6) AS candidate_rmse, round(c.rolling_stability, 6) AS rolling_stability, round(CASE WHEN c.variable IS NOT NULL THEN c.raw_corr END, 6) AS rolling_corr_median, round(c.rolling_sign_consistency, 6) AS rolling_sign_consistency, CASE WHEN c.variable IS NOT NULL THEN 7 END AS valid_window_count FROM n LEFT JOIN a USING (variable) LEFT JOIN b USING (variable) LEFT JOIN c USING (variable)"),
    "validation_fields": q(R, SCORED, FLAGGED, final="SELECT variable, lag AS initial_screening_lag, CAST(CASE WHEN rolling_stability IS NOT NULL THEN lag + 1 WHEN model_lift > 0.05 THEN lag WHEN granger_q <= 0.1 THEN lag - 2 END AS INT) AS validation_lag, CASE WHEN conditional_status = 'ok' THEN lag END AS conditional_validation_lag, round(model_lift, 6) AS screening_model_lift, round(CASE WHEN lift_status = 'ok' OR model_lift > 0.05 THEN model_lift END, 6) AS validation_model_lift FROM used"),
    "model_summary": f"WITH {FOLDS}, b AS (SELECT avg(rmse) AS r, avg(mae) AS a FROM f WHERE model = 'M1') SELECT model, count(*) AS fold_count, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(avg(mae), 6) AS mean_mae, round(median(mae), 6) AS median_mae, round(avg(r2), 6) AS mean_r2, round(CASE WHEN model = 'M2' THEN (any_value(r) - avg(rmse)) / any_value(r) * 100 END, 6) AS m2_vs_m1_rmse_improvement_pct, round(CASE WHEN model = 'M2' THEN (any_value(a) - avg(mae)) / any_value(a) * 100 END, 6) AS m2_vs_m1_mae_improvement_pct FROM f, b GROUP BY model",
    "candidate_uplift": f"WITH {FOLDS}, b AS (SELECT fold, avg(rmse) AS r, avg(mae) AS a FROM f WHERE model = 'M1' GROUP BY 1), c AS (SELECT concat('v', p_partkey) AS variable, CAST(p_partkey % 3 AS INT) AS fold, 1 + p_partkey % 19 / 9.0 AS rmse, p_partkey % 23 / 11.0 AS mae FROM part) SELECT variable, fold, round((r - rmse) / r * 100, 6) AS rmse_improvement_pct, round((a - mae) / a * 100, 6) AS mae_improvement_pct FROM c JOIN b USING (fold)",
    "display_fields": q(R, SCORED, FLAGGED, RANKED, "d AS (SELECT part, CASE method WHEN 'pearson' THEN pearson ELSE spearman END AS c FROM rf)", final="SELECT part, round(c, 6) AS dominant_corr, CASE WHEN c > 0.05 THEN 'positive' WHEN c < -0.05 THEN 'negative' ELSE 'weak' END AS correlation_direction FROM d"),
    "control_roles": q(
        R, SCORED, FLAGGED, "pt AS (SELECT part, risk_flags, concat(['FIC', 'TIC', 'XY', 'AI', 'PUMP', 'feed'][part % 6 + 1], part // 7, ['.PV', '.SV', '.MV', '', '.op', '.PV', ''][part % 7 + 1]) AS variable FROM used)",
        "lp AS (SELECT *, CASE WHEN contains(variable, '.') THEN split_part(variable, '.', 1) END AS loop_tag, upper(split_part(variable, '.', 2)) AS sfx, lower(concat(variable, ';', risk_flags)) AS txt FROM pt)",
        "rl AS (SELECT *, CASE WHEN concat(loop_tag, '.SV') IN (SELECT variable FROM pt) THEN concat(loop_tag, '.SV') END AS related_sv, CASE WHEN concat(loop_tag, '.MV') IN (SELECT variable FROM pt) THEN concat(loop_tag, '.MV') END AS related_mv FROM lp)",
        "ro AS (SELECT *, CASE WHEN sfx IN ('MV', 'SV') THEN 'mv_candidate' WHEN sfx = 'PV' AND (starts_with(upper(loop_tag), 'FIC') OR starts_with(upper(loop_tag), 'TIC') AND (related_sv IS NOT NULL OR related_mv IS NOT NULL)) THEN 'loop_mv_candidate' WHEN contains(variable, 'feed') THEN 'dv_feedforward_candidate' WHEN sfx = 'PV' OR regexp_matches(lower(variable), 'ai|ti|pi') THEN 'monitor_candidate' ELSE 'manual_review_only' END AS role FROM rl)",
        final="SELECT DISTINCT part, loop_tag, related_sv, related_mv, CASE WHEN regexp_matches(txt, 'target_leads_variable|strong_formula_leakage') THEN 'not_recommended_for_control' WHEN contains(txt, 'common_capacity_driver') THEN CASE role WHEN 'mv_candidate' THEN 'monitor_candidate' WHEN 'loop_mv_candidate' THEN 'manual_review_only' WHEN 'dv_feedforward_candidate' THEN 'manual_review_only' ELSE role END ELSE role END AS suggested_control_role FROM ro",
    ),
    "overview": q(R, SCORED, FLAGGED, final="SELECT count(*) AS effective_variables, count(*) FILTER (risk_count > 0) AS risk_tagged_count, count(*) FILTER (is_control_reference) AS control_reference_count, count(*) FILTER (candidate_grade IN ('A', 'B')) AS good_grades, least(25, count(*)) AS recommended_candidate_count FROM used"),
    "trend_bounds": q(K, "s AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM w)", final="SELECT min(t) AS lo, CAST(least(min(t) + 99 * median(step) FILTER (step > 0), max(t)) AS BIGINT) AS hi FROM s"),
    "expectation_errors": "WITH e AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE concat('v', p_partkey % 1999) END AS variable, ['reasonable_driver', 'implausible_driver', 'neutral', 'else'][p_partkey % 4 + 1] AS c FROM part), x AS (SELECT 'variable required' AS rule, count(*) AS n FROM e WHERE trim(variable) = '' UNION ALL SELECT 'doubled variable', count(*) FROM (SELECT variable FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown class', count(*) FROM e WHERE c = 'else') SELECT * FROM x WHERE n > 0",
    "baseline_metrics": q(
        R, SCORED, FLAGGED, RANKED, "e AS (SELECT *, CASE part % 7 WHEN 0 THEN 'r' WHEN 1 THEN 'i' WHEN 2 THEN 'n' END AS cl, candidate_grade IN ('A', 'B') AS ab FROM rf)", "k2 AS (SELECT unnest([10, 20]) AS cutoff)",
        final="SELECT cutoff, count(*) AS available_rows, count(*) FILTER (cl = 'r') AS reasonable_hits, count(*) FILTER (cl = 'i') AS implausible_hits, count(*) FILTER (list_contains(flags, 'poor_data_quality') OR list_contains(flags, 'severe_data_quality')) AS data_quality_risk_count, " + ", ".join(f"count(*) FILTER (list_contains(flags, '{f}')) AS {f}_count" for f in BASE_FLAGS) + ", " + ", ".join(f"count(*) FILTER (ab AND list_contains(flags, '{f}')) AS ab_{f}_count" for f in BASE_FLAGS if f != "lag_boundary") + ", round(count(*) FILTER (cl = 'r') / (SELECT count(*) FROM e WHERE cl = 'r'), 6) AS recall_of_expected, round(count(*) FILTER (cl = 'r') / (SELECT count(*) FROM e WHERE cl = 'r'), 6) AS recall_of_found, round(count(*) FILTER (cl = 'i') / count(*), 6) AS implausible_share FROM e JOIN k2 ON driver_rank <= cutoff GROUP BY cutoff",
    ),
    "first_step": q(K, GAPPED, "d AS (SELECT DISTINCT t FROM g)", "s AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS period FROM d)", final="SELECT period FROM s WHERE period > 0 ORDER BY t LIMIT 1"),
    "granger_order": q(R, final="SELECT part, row_number() OVER (ORDER BY CASE WHEN part % 9 = 0 THEN NULL ELSE granger_q END NULLS LAST, variable, lag) AS q_order FROM r"),
    "causal_frame": q(K, GAPPED, f"c AS (SELECT g.* FROM g WHERE t IN (SELECT t FROM g WHERE variable = '{TARGET}' AND value IS NOT NULL))", final=f"SELECT t, variable, round(CASE WHEN variable = '{TARGET}' THEN value ELSE last_value(value IGNORE NULLS) OVER (PARTITION BY variable, exact ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS value FROM c"),
    "fold_features": q(
        K, f"b AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM w WHERE {TARGET} IS NOT NULL)",
        # The last fold: a quarter of the rows tests, five rows (the largest lag) are a gap on both sides of the validation block.
        f"f AS (SELECT *, n - n // 4 AS a, n - n // 4 - 5 AS v1 FROM b)", "v AS (SELECT *, v1 - greatest(30, CAST(floor(v1 * 0.15) AS BIGINT)) AS v0 FROM f)",
        f"z AS (SELECT t, CASE WHEN i >= a THEN 'test' WHEN i >= v1 THEN 'gap_2' WHEN i >= v0 THEN 'validation' WHEN i >= v0 - 5 THEN 'gap_1' ELSE 'train' END AS part, CASE WHEN i >= v1 THEN 2 WHEN i >= v0 - 5 THEN 1 ELSE 0 END AS zone FROM v)",
        f"sg AS (SELECT t, part, zone, sum(coalesce((step <> {PERIOD})::INT, 0)) OVER (ORDER BY t) AS exact FROM (SELECT *, t - lag(t) OVER (ORDER BY t) AS step FROM z))",
        f"p AS (SELECT sg.t, part, zone, variable, CASE WHEN variable = '{TARGET}' THEN value ELSE last_value(value IGNORE NULLS) OVER (PARTITION BY variable, part, exact ORDER BY sg.t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS value FROM sg JOIN h USING (t) WHERE variable IN ('{TARGET}', 'click', 'error', '{CONTROL}'))",
        f"m AS (SELECT y.t, y.part, y.value AS y, x.variable, (y.t - x.t) // {PERIOD} AS k, x.value FROM p y JOIN p x ON x.zone = y.zone AND y.t - x.t BETWEEN {PERIOD} AND {MAX_LAG} * {PERIOD} AND (y.t - x.t) % {PERIOD} = 0 WHERE y.variable = '{TARGET}' AND y.part IN ('train', 'validation', 'test') AND x.value IS NOT NULL)",
        f"c AS (SELECT t, part, any_value(y) AS y, max(value) FILTER (variable = '{TARGET}' AND k = 1) AS y_1, max(value) FILTER (variable = '{CONTROL}' AND k = 5) AS view_5, max(value) FILTER (variable = 'click' AND k = 4) AS click_4, count(*) FILTER (variable IN ('{TARGET}', '{CONTROL}') AND k IN (1, 2, 5) OR variable = 'click' AND k BETWEEN 1 AND 4 OR variable = 'error' AND k BETWEEN 1 AND 5) AS there FROM m GROUP BY 1, 2)",
        final="SELECT part, t, round(y, 6) AS y, round(y_1, 6) AS y_1, round(view_5, 6) AS view_5, round(click_4, 6) AS click_4 FROM c WHERE there = 15",
    ),
    "review_assessments": q(
        R, SCORED, FLAGGED, "a AS (SELECT * REPLACE (CASE WHEN part % 10 = 0 THEN '' WHEN part % 10 = 5 THEN 'ok_fallback_missing_ranked_lag' WHEN part % 10 = 7 THEN 'fit_failed' ELSE conditional_status END AS conditional_status) FROM used)",
        final="""SELECT part, CASE WHEN conditional_status = '' THEN 'not_computed' WHEN conditional_status = 'high_collinearity_risk' THEN CASE WHEN predictive_contribution > 0 THEN 'supported_with_limitations' ELSE 'not_supported' END
 WHEN conditional_status = 'ok_fallback_missing_ranked_lag' THEN CASE WHEN predictive_contribution > 0 AND coalesce(conditional_q, 0) <= 0.1 THEN 'supported_with_limitations' ELSE 'not_supported' END
 WHEN conditional_status IN ('insufficient_rows', 'fit_failed') THEN 'not_computed' WHEN coalesce(conditional_q, 1) <= 0.1 AND predictive_contribution > 0 THEN 'supported' ELSE 'not_supported' END AS independent_predictive_support,
 CASE WHEN list_has_any(flags, ['formula_like', 'strong_formula_leakage']) OR recommended_use = 'formula_coupled_reference' THEN 'formula_relation_risk' WHEN list_contains(flags, 'common_capacity_driver') OR recommended_use = 'capacity_driven' THEN 'common_driver_risk'
 WHEN list_has_any(flags, ['residual_collinearity', 'redundant_proxy']) THEN 'shared_signal_risk' ELSE 'no_flagged_confounder' END AS confounder_assessment,
 CASE WHEN is_control_reference THEN 'control_reference' WHEN list_contains(flags, 'target_leads_variable') OR temporal_direction_status = 'target_leads_supported' OR lag < 0 OR recommended_use = 'state_indicator' THEN 'possible_control_response'
 WHEN list_contains(flags, 'common_capacity_driver') OR recommended_use = 'capacity_driven' THEN 'shared_capacity_or_control_context' ELSE 'no_control_relation_flagged' END AS control_relation_assessment,
 CASE WHEN conditional_status = 'high_collinearity_risk' OR list_contains(flags, 'residual_collinearity') OR condition_number > 1e8 THEN 'high_collinearity_limitation' WHEN conditional_status = 'insufficient_rows' THEN 'insufficient_sample_limitation' WHEN conditional_status = '' THEN 'not_computed'
 WHEN conditional_status = 'fit_failed' THEN 'failed_statistical_limitation' ELSE 'no_flagged_statistical_limitation' END AS statistical_limitation,
 CASE WHEN lag > 0 THEN 'variable_leads_target' WHEN lag < 0 THEN 'target_leads_variable' ELSE 'zero_lag' END AS direction_assessment FROM a""",
    ),
    "review_conflicts": q(
        R, SCORED, FLAGGED, "c AS (SELECT *, starts_with(conditional_status, 'ok') AND coalesce(conditional_q, 1) <= 0.05 AS sup FROM used)",
        final="SELECT part, array_to_string(list_filter([CASE WHEN part % 2 = 0 AND part % 3 > 0 THEN 'strong_screening_but_statistical_limited' END, CASE WHEN candidate_grade IN ('A', 'B') AND NOT sup THEN 'strong_screening_but_conditional_weak' END, CASE WHEN sup AND candidate_grade IN ('D', 'E') THEN 'conditional_supported_but_screening_weak' END, CASE WHEN importance_rank <= 5 AND NOT sup THEN 'model_supported_but_granger_weak' END, CASE WHEN list_contains(flags, 'lag_boundary') THEN 'boundary_lag_uncertain' END], lambda x: x IS NOT NULL), ';') AS conflict_types, CASE WHEN list_contains(flags, 'lag_boundary') THEN 'scan_further' ELSE '' END AS lag_boundary_hint FROM c",
    ),
    "review_rollup": "WITH f AS (SELECT concat('v', p_partkey % 50) AS variable, min(p_partkey * 60) AS tested_from, max(p_partkey * 60 + 30) AS tested_to FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1) SELECT u.variable, tested_from, tested_to, 15 AS sampling_minutes, CAST(NULL AS BIGINT) AS max_used_lag, CAST(NULL AS INT) AS partly, true AS sampling_minutes_consistent, false AS max_used_lag_consistent, false AS partly_consistent FROM (SELECT DISTINCT concat('v', p_partkey % 60) AS variable FROM part) u LEFT JOIN f USING (variable)",
    "screening": q(
        K.replace("median(value) AS value FROM ev", "round(median(value), 6) AS value FROM ev"), GAPPED, SCREEN_FRAME, gap_pairs("hh", "pairs"), S, B, PEAKS, DIAG.replace("FROM h", "FROM g"),
        f"c AS (SELECT x.t, x.side, x.variable, x.value AS x, y.value AS y, z.value AS z FROM hh x JOIN hh y ON y.t = x.t AND y.variable = '{TARGET}' JOIN hh z ON z.t = x.t AND z.variable = '{CONTROL}' WHERE x.variable NOT IN ('{TARGET}', '{CONTROL}') AND x.value IS NOT NULL AND y.value IS NOT NULL AND z.value IS NOT NULL)",
        "fit AS (SELECT variable, regr_slope(x, z) AS bx, regr_intercept(x, z) AS ax, regr_slope(y, z) AS cy, regr_intercept(y, z) AS ay FROM c GROUP BY 1)",
        "res AS (SELECT t, side, c.variable, x - ax - bx * z AS x, y - ay - cy * z AS y FROM c JOIN fit USING (variable))",
        f"zpairs AS (SELECT a.variable, l.lag, b.t, a.x, b.y FROM res a CROSS JOIN (SELECT unnest(range(-{MAX_LAG}, {MAX_LAG} + 1)) AS lag) l JOIN res b ON b.variable = a.variable AND b.side = a.side AND b.t = a.t + l.lag * {PERIOD})",
        scores("variable, lag", "zpairs", "zs"), best("variable", "zs", "zb"), REG.replace("FROM h", "FROM hh"), ROLL,
        f"rg AS (SELECT variable, count(DISTINCT regime) AS k, min(score) AS lo, max(score) AS hi, abs(sum(signed)) AS net, sum(abs(signed)) AS gross, stddev_pop(lag) AS sd FROM rbest GROUP BY 1)",
        f"rr AS (SELECT variable, CASE WHEN k < 2 THEN 'insufficient_regimes' WHEN k = 3 THEN 'full_coverage' ELSE 'partial_coverage' END AS regime_evidence_status, k / 3 AS regime_coverage, CASE WHEN k > 1 THEN lo / hi END AS regime_strength_consistency, CASE WHEN k > 1 THEN least(1, net / gross) END AS regime_sign_consistency, CASE WHEN k > 1 THEN greatest(0, 1 - sd / {MAX_LAG}.0) END AS regime_lag_consistency FROM rg)",
        "ro AS (SELECT variable, greatest(avg(CASE WHEN r >= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN r < 0 THEN 1.0 ELSE 0 END)) AS rolling_sign_consistency, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS rolling_corr_iqr, median(abs(r)) AS rolling_abs FROM roll GROUP BY 1)",
        f"mv AS (SELECT hh.t + b.lag * {PERIOD} AS t, hh.variable, hh.value, hh.side FROM hh JOIN b USING (variable) WHERE b.lag > 0 AND hh.value IS NOT NULL)",
        f"al AS (SELECT x.variable FROM mv x JOIN mv y ON x.t = y.t AND x.side = y.side AND x.variable <> y.variable JOIN (SELECT DISTINCT t, side FROM hh) z ON z.t = x.t AND z.side = x.side GROUP BY x.variable, y.variable HAVING count(*) >= 30 AND abs({corr('x.value', 'y.value')}) >= 0.995)",
        f"""r AS (SELECT b.variable, CAST(b.lag AS INT) AS lag, b.score AS association_score, b.score AS raw_corr, exp(-ln(2) * (missing_rate / 0.2 + saturation_ratio / 0.2 + abnormal_jump_ratio / 0.01 + robust_outlier_ratio / 0.01) / 4) AS data_quality_score, missing_rate, saturation_ratio, abnormal_jump_ratio, robust_outlier_ratio,
 {LAG_QUALITY} AS lag_quality, {DIRECTION} AS temporal_direction_status, abs(best_lag) = {MAX_LAG} AS lag_boundary_flag, CASE WHEN b.variable = '{CONTROL}' THEN 'control_reference_not_residualized' WHEN zb.variable IS NULL THEN 'no_valid_residual_lag' ELSE 'ok' END AS residual_status, zb.score AS residual_corr, regime_evidence_status, regime_coverage, regime_strength_consistency, regime_sign_consistency, regime_lag_consistency,
 regime_coverage * greatest(0, least(1, regime_sign_consistency * (0.6 * regime_strength_consistency + 0.4 * regime_lag_consistency))) AS regime_stability_final, rolling_sign_consistency, rolling_corr_iqr, rolling_abs * rolling_sign_consistency * (1 - least(1, rolling_corr_iqr)) AS rolling_stability,
 b.variable IN (SELECT variable FROM al) AS redundant, CAST(NULL AS VARCHAR) AS lift_status, CAST(NULL AS DOUBLE) AS model_lift, 1.0 AS condition_number FROM b JOIN pq USING (variable) JOIN diag USING (variable) LEFT JOIN zb ON zb.variable = b.variable LEFT JOIN rr ON rr.variable = b.variable LEFT JOIN ro ON ro.variable = b.variable)""",
        SCORED, FLAGGED,
        final="SELECT CAST(row_number() OVER (ORDER BY final_score DESC NULLS LAST, association_score DESC NULLS LAST, lag_quality DESC NULLS LAST, variable) AS INT) AS driver_rank, variable, lag, round(final_score, 6) AS final_score, candidate_grade, recommended_use, risk_flags FROM used",
    ),
}
