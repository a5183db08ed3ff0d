"""The frames that queries run on, made from the test tables.

hourly: median event value per hour and event type, long, with a null row for
each hour and type without events. rules: one row a part, with made-up inputs of the
rule functions, so that every branch is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.filters import gap_starts, window_mask
from .operators.preprocess import to_long, with_segments
from .sources.tables import seconds_of

TARGET = "purchase"
CONTROL = "view"
MAX_LAG = 6
PERIOD = 3600
VARIABLES = ["click", "error", "purchase", "signup", "view"]

#: Expressions that mean the same in Spark SQL and DuckDB.
RULES = {
    "variable": "concat('v', cast(p_partkey as varchar(20)), case when p_partkey % 11 = 0 then '.MV' when p_partkey % 13 = 0 then '_sp' when p_partkey % 7 = 0 then '_flow_rate' else '' end)",
    "association_score": "(p_partkey % 97) / 96.0e0",
    "data_quality_score": "1 - (p_partkey % 53) / 104.0e0",
    "raw_corr": "(p_partkey % 97) / 96.0e0",
    "lag": "cast(p_partkey % 13 as int) - 6",
    "lag_quality": "(p_partkey % 41) / 40.0e0",
    "residual_status": "case p_partkey % 4 when 0 then 'ok' when 1 then 'rank_deficient' when 2 then 'ok' else 'insufficient' end",
    "residual_corr": "case when p_partkey % 5 = 0 then null else (p_partkey % 89) / 88.0e0 end",
    "residual_lag_quality": "case when p_partkey % 6 = 0 then null else (p_partkey % 31) / 30.0e0 end",
    "residual_n": "p_partkey % 120",
    "rolling_sign_consistency": "case when p_partkey % 7 = 3 then null else 0.5e0 + (p_partkey % 51) / 100.0e0 end",
    "rolling_corr_iqr": "(p_partkey % 60) / 50.0e0",
    "rolling_stability": "case when p_partkey % 9 = 4 then null else (p_partkey % 71) / 70.0e0 end",
    "regime_evidence_status": "case p_partkey % 3 when 0 then 'full_coverage' when 1 then 'partial_coverage' else 'insufficient_regimes' end",
    "regime_coverage": "case when p_partkey % 3 = 2 then null else 1 - (p_partkey % 3) / 3.0e0 end",
    "regime_strength_consistency": "(p_partkey % 37) / 36.0e0",
    "regime_sign_consistency": "(p_partkey % 29) / 28.0e0",
    "regime_lag_consistency": "(p_partkey % 23) / 22.0e0",
    "regime_stability_final": "case when p_partkey % 3 = 2 then null else (p_partkey % 43) / 42.0e0 end",
    "temporal_direction_status": "case p_partkey % 5 when 0 then 'target_leads_supported' when 1 then 'synchronous' when 2 then 'variable_leads_supported' else 'direction_unresolved' end",
    "lag_boundary_flag": "p_partkey % 13 in (0, 12)",
    "redundant": "p_partkey % 17 = 0",
    "lift_status": "case when p_partkey % 4 = 1 then 'skipped: insufficient rows' else 'ok' end",
    "model_lift": "(p_partkey % 25) / 250.0e0",
    "condition_number": "case when p_partkey % 19 = 0 then 1.0e9 else 10.0e0 end",
    "missing_rate": "(p_partkey % 61) / 100.0e0",
    "saturation_ratio": "(p_partkey % 91) / 100.0e0",
    "abnormal_jump_ratio": "(p_partkey % 67) / 1000.0e0",
    "robust_outlier_ratio": "(p_partkey % 59) / 1000.0e0",
    "is_control_reference": "p_partkey % 31 = 0",
    "conditional_status": "case p_partkey % 6 when 0 then 'high_collinearity_risk' when 1 then 'insufficient_rows' when 2 then 'ok_fallback' else 'ok' end",
    "conditional_q": "case when p_partkey % 8 = 7 then null else (p_partkey % 33) / 200.0e0 end",
    "predictive_contribution": "(p_partkey % 47) / 400.0e0 - 0.01e0",
    "granger_q": "(p_partkey % 39) / 250.0e0",
    "importance_rank": "p_partkey % 21",
    "sign_consistency": "(p_partkey % 27) / 26.0e0",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (whole seconds), variable, value, event_id."""
    return read(spark, sf_dir, "events").select(seconds_of(F.col("ts")).alias("t"), F.col("event_type").alias("variable"), "value", "event_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, variable, value with nulls where an hour has no such event."""
    wide = hourly_wide(spark, sf_dir)
    return wide.select("t", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in VARIABLES])))


def hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t and a median a variable: the pivot and the medians are one aggregation, so one shuffle."""
    e = events(spark, sf_dir).withColumn("t", F.col("t") - F.pmod("t", F.lit(PERIOD)))
    return e.groupBy("t").agg(*[F.median(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in VARIABLES])


def hours(spark: SparkSession, sf_dir: str) -> int:
    """A bound on the rows of an hourly series, from the first and last event."""
    lo, hi = read(spark, sf_dir, "events").agg(F.min(seconds_of(F.col("ts"))), F.max(seconds_of(F.col("ts")))).first()
    return 0 if lo is None else (hi - lo) // PERIOD + 2


def windows(wide: DataFrame) -> list[dict]:
    """Two windows to exclude, by the first hour."""
    first = wide.agg(F.min("t")).first()[0]
    return [{"start": first + 7200, "end": first + 36000}, {"start": first + 72000, "end": first + 90000}]


def gapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """hourly without the rows of windows(), with its segments (exact, tolerant), and the first hour after each window."""
    wide = hourly_wide(spark, sf_dir)
    hit = window_mask(windows(wide))
    starts = sorted(r["t"] for r in gap_starts(wide, hit).collect())
    return with_segments(to_long(wide.where(~hit), VARIABLES), PERIOD, starts), starts


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*[f"{e} as {c}" for c, e in RULES.items()], "p_partkey as part")
