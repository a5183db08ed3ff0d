"""Cleaning and transforming long frames (t, variable, value)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DETREND_WINDOW, INTERPOLATE_LIMIT, LOWPASS_TAU_MINUTES, TOLERANT_STEP
from .axis import resample, resample_segments, sample_period, segment_ids
from ..sources.staging import forget, stored
from .filters import lag_sources, tercile_segment


def keyed(keys: list[str]):
    return Window.partitionBy("variable", *keys).orderBy("t")


def interpolate(long: DataFrame, limit: int = INTERPOLATE_LIMIT, keys: list[str] = ()) -> DataFrame:
    """Linear in time between known values; the first `limit` nulls of a gap are filled, nulls at the ends are not."""
    w = keyed(list(keys))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("t"))
    rows = long.withColumns(
        {
            "_v0": F.last("value", True).over(back), "_t0": F.last(known, True).over(back),
            "_v1": F.first("value", True).over(ahead), "_t1": F.first(known, True).over(ahead),
            "_k": F.count("value").over(back),
        }
    )
    run = F.row_number().over(Window.partitionBy("variable", *keys, "_k").orderBy("t")) - 1
    rows = rows.withColumn("_run", F.when(F.col("_k") > 0, run))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("t") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_run") <= limit, line)
    return rows.withColumn("value", filled).drop("_v0", "_t0", "_v1", "_t1", "_k", "_run")


def forward_fill(long: DataFrame, limit: int, keys: list[str] = ()) -> DataFrame:
    """Nulls take the last value at most `limit` rows before them."""
    return long.withColumn("value", F.last("value", True).over(keyed(list(keys)).rowsBetween(-limit, 0)))


def standardize(long: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(value - mean) / population deviation per variable; a deviation of 0 counts as 1. targets: the times that both come from."""
    inside = F.lit(True)
    if targets is not None:
        long = long.join(targets.select("t", F.lit(True).alias("_in")), "t", "left")
        inside = F.coalesce("_in", F.lit(False))
    chosen = F.when(inside, F.col("value"))
    # A variable without values at those times takes both from all of its own.
    stats = long.groupBy("variable").agg(F.coalesce(F.avg(chosen), F.avg("value")).alias("_m"), F.coalesce(F.stddev_pop(chosen), F.stddev_pop("value")).alias("_s"))
    scaled = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    return long.join(stats, "variable").withColumn("value", scaled).drop("_m", "_s", "_in")


def low_passed(t: np.ndarray, x: np.ndarray, tau_seconds: float) -> np.ndarray:
    """The filter's path over known values, in blocks of so many time constants that their exponentials stay in range.

    Inside a block each value is the carried one and the weighted inputs since, both decayed: a running sum.
    """
    out = np.array(x, float)
    step = np.diff(t) / tau_seconds
    gain = -np.expm1(-step)
    age = np.concatenate([[0.0], np.cumsum(step)])
    i = 1
    while i < len(x):
        j = int(np.searchsorted(age, age[i - 1] + 300, "right"))
        if j <= i:  # one step of more than 300 time constants
            out[i] = out[i - 1] + gain[i - 1] * (x[i] - out[i - 1])
            i += 1
            continue
        grown = np.exp(age[i:j] - age[i - 1])
        out[i:j] = (out[i - 1] + np.cumsum(gain[i - 1 : j - 1] * x[i:j] * grown)) / grown
        i = j
    return out


def lowpass(long: DataFrame, tau_minutes: float = LOWPASS_TAU_MINUTES, keys: list[str] = ()) -> DataFrame:
    """First-order low-pass: y += (1 - exp(-dt / tau)) (x - y) between known values, in each variable (and keys, as segments).

    Each series (or segment of one) runs in one task; they are the parallel axis.
    """
    names = long.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        value = part["value"].to_numpy(float)
        known = ~np.isnan(value)
        out = np.full(len(part), np.nan)
        if known.any():
            out[known] = low_passed(part["t"].to_numpy(float)[known], value[known], tau_minutes * 60)
        part["value"] = out
        return part[names]

    out = long.groupBy("variable", *keys).applyInPandas(run, long.schema)
    return out.withColumn("value", F.nanvl(F.col("value"), F.lit(None).cast("double")))


def detrend_centered(long: DataFrame, window: int = DETREND_WINDOW, keys: list[str] = ()) -> DataFrame:
    """Minus the centred moving mean of max(3, window) rows, where at least max(2, window / 4) are known."""
    w = max(3, window)
    frame = keyed(list(keys)).rowsBetween(-(w // 2), w - w // 2 - 1)
    enough = F.count("value").over(frame) >= max(2, w // 4)
    return long.withColumn("value", F.when(enough, F.col("value") - F.avg("value").over(frame)))


def detrend_trailing(long: DataFrame, window: int = DETREND_WINDOW, keys: list[str] = ()) -> DataFrame:
    w = max(3, window)
    frame = keyed(list(keys)).rowsBetween(-(w - 1), 0)
    enough = F.count("value").over(frame) >= max(2, w // 4)
    return long.withColumn("value", F.when(enough, F.col("value") - F.avg("value").over(frame)))


def difference(long: DataFrame, k: int = 1, keys: list[str] = ()) -> DataFrame:
    """value minus the value k rows before, inside (variable, keys); give segments as keys."""
    return long.withColumn("value", F.col("value") - F.lag("value", k).over(keyed(list(keys))))


def diff_interval(minutes: float, period: int) -> int:
    """Rows of an interval: at least 1, halves to even."""
    if not minutes > 0 or math.isinf(minutes):
        raise ValueError(f"bad interval: {minutes}")
    return max(1, round(minutes * 60 / period))


def transform(long: DataFrame, mode: str, *, window: int = DETREND_WINDOW, tau_minutes: float = LOWPASS_TAU_MINUTES, k: int = 1, causal: bool = False, keys: list[str] = ()) -> DataFrame:
    """raw, detrend, diff, detrend_diff, lowpass, lowpass_detrend, lowpass_diff.

    keys: segment columns that filters, differences and causal means do not cross; centred means run over all rows.
    """
    keys = list(keys)
    detrend = (lambda d: detrend_trailing(d, window, keys)) if causal else (lambda d: detrend_centered(d, window))
    steps = {"lowpass": lambda d: lowpass(d, tau_minutes, keys), "detrend": detrend, "diff": lambda d: difference(d, k, keys)}
    if mode == "raw":
        return long
    for part in mode.split("_"):
        if part not in steps:
            raise ValueError(f"bad mode: {mode}")
        long = steps[part](long)
    return long


def with_segments(long: DataFrame, period: int, starts: list[int] = ()) -> DataFrame:
    """long with exact (any other step than the period ends one) and tolerant (a step of more than TOLERANT_STEP periods does)."""
    times = long.select("t").distinct()
    exact = segment_ids(times, period, starts=list(starts), out="exact")
    both = segment_ids(exact, period, tolerance=TOLERANT_STEP, starts=list(starts), out="tolerant")
    return long.join(both, "t")


@dataclass(frozen=True)
class Frame:
    """A prepared long frame (t, variable, value, exact, tolerant) and what its rows have no column for."""

    long: DataFrame
    variables: tuple[str, ...]
    period: int
    starts: tuple[int, ...]
    targets: DataFrame | None = None
    protected_constant: tuple[str, ...] = ()
    rows: int = 0
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        forget(*self.held)


def prepare(wide: DataFrame, target: str, *, resample_seconds: int | None = None, min_valid: float = 0.7, protected: list[str] = (), limit: int = INTERPOLATE_LIMIT, starts: list[int] = (), by_gaps: bool = False, segment: tuple[str, str, float | None, float | None] | None = None, max_lag: int = 0) -> Frame:
    """Resampling, interpolation, operating segment and column admission, in this order; all times stay.

    Where rows were excluded (by_gaps), each physical segment is resampled and interpolated on its own. Admission counts the values
    before interpolation, at the times of the operating segment; with one, a variable with values that lags could read outside it stays too.
    """
    names = [c for c in wide.columns if c != "t"]
    period = sample_period(wide.select("t")).first()["period"] or 1
    long = to_long(wide, names)
    if resample_seconds:
        if by_gaps:
            parts = stored(segment_ids(wide.select("t"), period, starts=list(starts)))
            long = resample_segments(long, resample_seconds, parts).select("t", "variable", "value")
            starts = [r["t"] for r in parts.groupBy("segment").agg(F.min("t").alias("t")).where("segment > 0").collect()]  # a row a gap
        else:
            long = resample(long, resample_seconds)
        period = sample_period(long.select("t")).first()["period"] or 1
    long = stored(with_segments(long, period, starts))
    filled = interpolate(long, limit, ["exact"] if by_gaps else [])
    targets = None
    if segment and segment[1] != "all":
        wanted = tercile_segment(filled.where(F.col("variable") == segment[0]).select("t", F.col("value").alias(segment[0])), segment[0], *segment[1:])
        targets = stored(wanted.select("t"))
    safe = [target, *protected]
    chosen = long if targets is None else long.join(targets, "t", "left_semi")
    counts = chosen.groupBy("variable").agg((F.count("value") / F.count(F.lit(1))).alias("ratio"))
    held = (long, *([] if targets is None else [targets]), *([parts] if resample_seconds and by_gaps else []))
    if targets is not None:
        history = lag_sources(long.select("t").distinct(), targets, max_lag, period).join(targets, "t", "left_anti")
        past = long.join(history, "t", "left_semi").groupBy("variable").agg((F.count("value") > 0).alias("past"))
        counts = counts.join(past, "variable", "left")
    else:
        counts = counts.withColumn("past", F.lit(False))
    varied = filled.groupBy("variable").agg(F.count("value").alias("known"), F.countDistinct("value").alias("kinds"), F.count(F.lit(1)).alias("rows"))
    facts = {r["variable"]: r for r in counts.join(varied, "variable").collect()}  # a row a variable
    if target not in facts or facts[target]["known"] < 10:
        raise ValueError("fewer than 10 known values of the target")
    admitted = [v for v in names if facts[v]["known"] and (v in safe or ((facts[v]["ratio"] >= min_valid or facts[v]["past"]) and facts[v]["kinds"] > 1))]
    constant = tuple(v for v in admitted if v in protected and facts[v]["kinds"] <= 1)
    return Frame(filled.where(F.col("variable").isin(admitted)), tuple(admitted), period, tuple(starts), targets, constant, facts[target]["rows"], held)


def causal_frame(long: DataFrame, target: str, limit: int, keys: list[str] = ()) -> DataFrame:
    """Rows with a known target; of these, the other variables are filled forward, inside keys (segments) only."""
    kept = long.where((F.col("variable") == target) & F.col("value").isNotNull()).select("t")
    rows = long.join(kept, "t", "left_semi")
    filled = F.when(F.col("variable") == target, F.col("value")).otherwise(F.last("value", True).over(keyed(list(keys)).rowsBetween(-limit, 0)))
    return rows.withColumn("value", filled)


def to_wide(long: DataFrame, variables: list[str]) -> DataFrame:
    return long.groupBy("t").pivot("variable", variables).agg(F.first("value", True))


def to_long(wide: DataFrame, variables: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return wide.select("t", F.inline(pairs))
