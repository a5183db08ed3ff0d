"""Stability of an association across operating regimes and over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_REGIMES, REGIME_WEIGHT_LAG, REGIME_WEIGHT_STRENGTH, REGIMES
from ..functions.mathx import clip
from .association import best_lags, lag_scores


def regimes(long: DataFrame, capacity: str) -> DataFrame:
    """t, regime: disjoint terciles of the capacity variable (<= q1, (q1, q2], > q2)."""
    rows = long.where((F.col("variable") == capacity) & F.col("value").isNotNull())
    q = rows.agg(F.percentile("value", F.lit(1 / 3)).alias("q1"), F.percentile("value", F.lit(2 / 3)).alias("q2"))
    regime = F.when(F.col("value") <= F.col("q1"), "low").when(F.col("value") <= F.col("q2"), "mid").otherwise("high")
    return rows.join(F.broadcast(q)).select("t", regime.alias("regime"))  # one row


def regime_scores(long: DataFrame, target: str, capacity: str, max_lag: int, period: int, starts: list[int] = (), targets: DataFrame | None = None, rows: int | None = None, basis: DataFrame | None = None) -> DataFrame:
    """Best lag of each variable inside each regime (of the target's time); basis: the long frame whose levels make the regimes."""
    parts = regimes(long if basis is None else basis, capacity)
    if targets is not None:
        parts = parts.join(targets.select("t"), "t", "left_semi")
    others = long.where(F.col("variable") != capacity)
    scores = lag_scores(others, target, max_lag, period, starts=list(starts), targets=parts, rows=rows, group="regime")
    return best_lags(scores, ["variable", "regime"]).select("variable", "regime", "lag", "score", F.col("signed").alias("signed_corr"), "n")


def regime_robustness(scores: DataFrame, max_lag: int) -> DataFrame:
    """One row a variable from (variable, regime, score, signed_corr, lag)."""
    s = clip("score")
    g = scores.where(F.col("regime").isin(*REGIMES)).groupBy("variable").agg(
        F.countDistinct("regime").alias("regime_count"), F.count("score").alias("n_score"), F.count("signed_corr").alias("n_signed"), F.count("lag").alias("n_lag"),
        F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"),
        F.abs(F.sum("signed_corr")).alias("net"), F.sum(F.abs("signed_corr")).alias("gross"), F.stddev_pop("lag").alias("lag_sd"),
        (F.coalesce(F.max("signed_corr") > 0, F.lit(False)) & F.coalesce(F.min("signed_corr") < 0, F.lit(False))).alias("regime_sign_reversal_flag"),
    )
    enough = F.least("n_score", "n_signed", "n_lag") >= MIN_REGIMES
    status = (
        F.when(F.col("regime_count") < MIN_REGIMES, "insufficient_regimes").when(~enough, "insufficient_metrics")
        .when(F.col("regime_count") == len(REGIMES), "full_coverage").otherwise("partial_coverage")
    )
    ok = F.col("regime_evidence_status").isin("full_coverage", "partial_coverage")
    g = g.withColumns({"regime_evidence_status": status, "regime_coverage": F.col("regime_count") / len(REGIMES), "regime_score_cv": F.when((F.col("n_score") >= 2) & (F.abs("mean") > 1e-12), F.col("sd") / F.abs("mean"))})
    g = g.withColumns(
        {
            "regime_strength_consistency": F.when(ok, F.when(F.col("hi") > 1e-12, clip(F.col("lo") / F.nullif("hi", F.lit(0.0)))).otherwise(0.0)),
            "regime_sign_consistency": F.when(ok, F.when(F.col("gross") > 1e-12, clip(F.col("net") / F.nullif("gross", F.lit(0.0)))).otherwise(0.0)),
            "regime_lag_consistency": F.when(ok, clip(1 - F.col("lag_sd") / max(1.0, float(max_lag)))),
        }
    )
    shape = REGIME_WEIGHT_STRENGTH * F.col("regime_strength_consistency") + REGIME_WEIGHT_LAG * F.col("regime_lag_consistency")
    g = g.withColumn("regime_consistency_score", F.when(ok, clip(F.col("regime_sign_consistency") * shape)))
    g = g.withColumn("regime_stability_final", F.when(ok, clip(F.col("regime_coverage") * F.col("regime_consistency_score"))))
    return g.select("variable", "regime_stability_final", "regime_consistency_score", "regime_coverage", "regime_strength_consistency", "regime_sign_consistency", "regime_lag_consistency", "regime_score_cv", "regime_count", "regime_evidence_status", "regime_sign_reversal_flag")


def rolling_correlations(pairs: DataFrame, window: int, least: int) -> DataFrame:
    """variable, t, r: correlation over the last `window` rows of (variable, segment), from windowed sums."""
    w = Window.partitionBy("variable", "segment").orderBy("t").rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(w)
    sums = {"n": n, "sx": F.sum("x").over(w), "sy": F.sum("y").over(w), "sxx": F.sum(F.col("x") * F.col("x")).over(w), "syy": F.sum(F.col("y") * F.col("y")).over(w), "sxy": F.sum(F.col("x") * F.col("y")).over(w)}
    rows = pairs.withColumns(sums).where(F.col("n") >= least)
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return rows.withColumns({"vx": vx, "vy": vy}).where("vx > 1e-9 and vy > 1e-9").select("variable", "t", clip(r, -1.0, 1.0).alias("r"))


def rolling_stability(rolling: DataFrame) -> DataFrame:
    g = rolling.groupBy("variable").agg(
        F.median("r").alias("rolling_corr_median"), F.median(F.abs("r")).alias("rolling_abs_corr_median"),
        (F.percentile("r", F.lit(0.75)) - F.percentile("r", F.lit(0.25))).alias("rolling_corr_iqr"),
        F.greatest(F.avg((F.col("r") >= 0).cast("double")), F.avg((F.col("r") < 0).cast("double"))).alias("rolling_sign_consistency"),
        F.count(F.lit(1)).alias("valid_window_count"),
    )
    return g.withColumn("rolling_stability", clip(F.col("rolling_abs_corr_median") * F.col("rolling_sign_consistency") * (1 - F.least(F.lit(1.0), F.col("rolling_corr_iqr")))))
