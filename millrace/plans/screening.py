"""The screening plan: from a wide numeric frame to ranked, flagged and graded variables, and the later stages."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import association, axis, causality, preprocess, quality, ranking, residual, review, stability
from ..operators.filters import condition_mask, control_reference, gap_starts, window_mask
from ..sources.staging import forget, stored

REDUNDANCY_FIELDS = ["independence", "model_lift", "data_quality_score", "stability", "lag_quality", "association_score"]


@dataclass(frozen=True)
class Config:
    target: str
    max_lag: int = C.MAX_LAG
    top_k: int = C.TOP_K
    mode: str = "raw"
    controls: tuple[str, ...] = ()
    capacity: str | None = None
    forced: tuple[str, ...] = ()
    min_valid_ratio: float = C.MIN_VALID_RATIO
    exclude_windows: tuple[dict, ...] = field(default=())
    exclude_rules: tuple[dict, ...] = field(default=())
    resample_seconds: int | None = None
    interpolate_limit: int = C.INTERPOLATE_LIMIT
    detrend_window: int = C.DETREND_WINDOW
    lowpass_tau_minutes: float = C.LOWPASS_TAU_MINUTES
    diff_minutes: float | None = None
    segment_column: str | None = None
    segment_mode: str = "all"
    segment_min: float | None = None
    segment_max: float | None = None

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, values: dict) -> Config:
        """The inverse of to_json; names it does not know are errors."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @property
    def protected(self) -> list[str]:
        return list(dict.fromkeys(c for c in (self.segment_column, self.capacity, *self.controls, *self.forced) if c))


@dataclass
class Screening:
    frame: preprocess.Frame
    long: DataFrame
    lag_scores: DataFrame
    best: DataFrame
    peaks: DataFrame
    diagnostics: DataFrame
    residual: DataFrame
    regimes: DataFrame
    rolling: DataFrame
    redundant: DataFrame
    ranked: DataFrame
    pool: DataFrame
    held: tuple[DataFrame, ...] = ()

    @property
    def period(self) -> int:
        return self.frame.period

    def release(self) -> None:
        """Delete what was stored for the tables above; they can't be read afterwards."""
        self.frame.release()
        forget(*self.held)


def rolling_table(long: DataFrame, best: DataFrame, target: str, max_lag: int, period: int, rows: int, starts: list[int] = (), targets: DataFrame | None = None) -> DataFrame:
    pairs = axis.lagged_pairs(long, target, best.select("variable", "lag"), period, list(starts), targets)
    times = axis.segment_ids(pairs.select("variable", "t", "x", "y"), period, starts=list(starts), keys=["variable"])
    window = max(12, min(rows, max(24, 4 * max_lag)))
    return stability.rolling_stability(stability.rolling_correlations(times, window, max(6, window // 2)))


def retained(wide: DataFrame, config: Config) -> tuple[DataFrame, list[int]]:
    """The rows that exclusions leave, and the first kept time after each run of excluded ones."""
    if not config.exclude_windows and not config.exclude_rules:
        return wide, []
    hit = window_mask(list(config.exclude_windows)) | condition_mask(list(config.exclude_rules))
    starts = [r["t"] for r in gap_starts(wide, hit).collect()]  # a row an excluded run
    return wide.where(~hit), sorted(starts)


def prepared(wide: DataFrame, config: Config) -> tuple[preprocess.Frame, DataFrame]:
    """The cleaned frame, and its transformed and standardised long table (with segments)."""
    kept, starts = retained(wide, config)
    segment = (config.segment_column, config.segment_mode, config.segment_min, config.segment_max) if config.segment_column else None
    excluded = bool(config.exclude_windows or config.exclude_rules)
    frame = preprocess.prepare(
        kept, config.target, resample_seconds=config.resample_seconds, min_valid=config.min_valid_ratio, protected=config.protected, limit=config.interpolate_limit,
        starts=starts, by_gaps=excluded, segment=segment, max_lag=config.max_lag,
    )
    k = 1 if config.diff_minutes is None else preprocess.diff_interval(config.diff_minutes, frame.period)
    moved = preprocess.transform(frame.long, config.mode, window=config.detrend_window, tau_minutes=config.lowpass_tau_minutes, k=k, keys=["tolerant"])
    return frame, preprocess.standardize(moved, frame.targets)


def screen(wide: DataFrame, config: Config) -> Screening:
    """wide: t and numeric columns. Small facts (period, gap starts, admitted columns) are computed at once; the long frame and the lag scores are kept for the tables that read them."""
    variables = [c for c in wide.columns if c != "t"]
    frame, scaled = prepared(wide, config)
    long = stored(scaled)
    target, most, period, starts = config.target, config.max_lag, frame.period, list(frame.starts)
    scored = association.lag_scores(long, target, most, period, starts=starts, targets=frame.targets, rows=frame.rows)
    scores = stored(association.with_q_values(association.with_p_values(scored)))
    best = association.best_lags(scores)
    if config.mode.endswith("diff"):
        near = best.select("variable", F.col("lag").alias("innovation_lag"), F.col("score").alias("innovation_score"), F.lit("innovation_verified").alias("innovation_status"))
    else:
        near = association.innovation(long, target, best, most, period, ["exact"], starts, frame.targets).select("variable", "innovation_lag", "innovation_score", "innovation_status")
    best = stored(best.join(near, "variable", "left"))
    peaks = association.peak_quality(scores, most)
    diag = quality.diagnostics(preprocess.to_long(retained(wide, config)[0], variables)).withColumn("data_quality_score", quality.quality_score())
    controls = list(config.controls) or ([config.capacity] if config.capacity else [])
    held = [long, scores, best]
    if controls:
        lags = stored(residual.residual_scores(long, target, controls, most, period, starts, frame.targets))
        held.append(lags)
        res = residual.residual_corr(lags, most)
    else:
        res = best.limit(0).select("variable", F.col("lag").alias("residual_lag"), F.col("score").alias("residual_corr"), F.col("n").alias("residual_n"), F.lit("ok").alias("residual_status"), F.col("score").alias("residual_lag_quality"), F.col("score").alias("condition_number"))
    basis = next((c for c in (config.segment_column, config.capacity, *config.controls) if c and c != target and c in frame.variables), None)
    if basis:
        found = stability.regime_scores(long, target, basis, most, period, starts, frame.targets, frame.rows, frame.long)
    else:
        found = best.limit(0).select("variable", F.lit("low").alias("regime"), "lag", "score", F.col("signed").alias("signed_corr"))
    regimes = stability.regime_robustness(found, most)
    rolling = rolling_table(long, best, target, most, period, frame.rows, starts, frame.targets)
    joined = stored(evidence(best, peaks, diag, res, regimes, rolling))
    held.append(joined)
    redundant = redundancy(long, target, joined, period, starts)
    ranked = stored(rank(joined.join(redundant, "variable", "left"), bool(controls), list(config.controls)))
    held.append(ranked)
    pool = ranking.recommended_pool(ranked, res, config.top_k, list(config.forced))
    return Screening(frame, long, scores, best, peaks, diag, res, regimes, rolling, redundant, ranked, pool, tuple(held))


def evidence(best: DataFrame, peaks: DataFrame, diag: DataFrame, res: DataFrame, regimes: DataFrame, rolling: DataFrame) -> DataFrame:
    """All evidence side by side. Every table has a row a variable."""
    joined = best.withColumn("raw_corr", F.col("score")).withColumn("association_score", F.col("score"))
    for t in (peaks.drop("best_lag", "best_score"), diag, res, regimes, rolling):
        joined = joined.join(t, "variable", "left")
    return joined.withColumns({"lift_status": F.lit(None).cast("string"), "model_lift": F.lit(None).cast("double")})


def redundancy(long: DataFrame, target: str, joined: DataFrame, period: int, starts: list[int]) -> DataFrame:
    """variable, redundancy_group, redundant: among variables that lead, aligned by their lags."""
    leading = joined.where("lag > 0").select("variable", "lag")
    pairs = association.redundant_pairs(long, target, leading, period, starts)
    groups = association.redundancy_groups(pairs, leading)
    profile = joined.select(
        "variable", F.col("residual_corr").alias("independence"), "model_lift", "data_quality_score",
        F.coalesce("regime_stability_final", "rolling_stability").alias("stability"), "lag_quality", "association_score",
    )
    return association.redundant_variables(groups, profile, REDUNDANCY_FIELDS).withColumnRenamed("group", "redundancy_group")


def rank(joined: DataFrame, has_controls: bool, controls: list[str]) -> DataFrame:
    """Scores, flags, grades and the order of evidence() with a column `redundant`."""
    is_control = F.col("variable").isin(controls) if controls else F.lit(False)
    joined = joined.withColumn("is_control_reference", is_control | control_reference(F.col("variable")).isNotNull())
    graded = ranking.recommended_use(ranking.risk_flags(ranking.score_components(joined), has_controls))
    return ranking.rank_rows(graded, ranking.initial_order(), "driver_rank")


def confirm(s: Screening, config: Config) -> dict[str, DataFrame]:
    """The later stages over the screened frame: Granger, conditional Granger, lift and review decisions."""
    g = causality.granger(s.long, config.target, config.max_lag, s.period)
    lift = causality.model_lift(s.long, config.target, s.best, config.max_lag, s.period)
    out = {"granger": g, "model_lift": lift}
    if config.controls:
        c = causality.conditional_granger(s.long, config.target, list(config.controls), config.max_lag, s.period)
        best = c.groupBy("variable").agg(F.min_by("status", F.coalesce("q", F.lit(2.0))).alias("conditional_status"), F.min("q").alias("conditional_q"), F.max_by("contribution", -F.coalesce("q", F.lit(2.0))).alias("predictive_contribution"))
        queue = review.review_candidates(s.ranked).join(best, "variable", "left")
        out |= {"conditional_granger": c, "review": queue.withColumn("decision", review.review_decision())}
    return out
