"""Out-of-time validation: M0, M1, M2 and a model for each candidate, on expanding folds whose parts are prepared on their own.

M0 sees the last target, M1 the target and the controls at fixed lags, M2 all candidates
around their lags besides, and each candidate's model M1 and its own lags only. Every fold
is cut into train, gap, validation, gap and test. Each part is filled and transformed
without looking beyond its ends; lags of validation and test rows may read the gap before
them. All (fold, model) fits are tasks of one job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.boosting import Settings, boosted
from ..operators import axis, preprocess, stages, validation
from ..sources.staging import forget, stored

METRICS = "fold int, model string, train_rows long, validation_rows long, test_rows long, best_iteration int, rmse double, mae double, r2 double"
#: Rows of a fold that one task fits; more are an error (use operators.validation.boosted_folds).
FIT_ROWS = 1_000_000
MIN_ROWS = {"train": 100, "validation": 30, "test": 30}


@dataclass
class Validation:
    status: str
    splits: list[validation.Split]
    rows: DataFrame
    fold_metrics: DataFrame
    model_summary: DataFrame
    candidate_metrics: DataFrame
    uplift: DataFrame
    fingerprint: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        forget(*self.held)


def parts_of(base: DataFrame, splits: list[validation.Split]) -> DataFrame:
    """t, fold, part (train, gap_1, validation, gap_2, test), zone: the parts whose rows lags may join."""
    cuts = []
    for s in splits:
        ranges = {"train": s.train, "gap_1": (s.train[1], s.validation[0]), "validation": s.validation, "gap_2": (s.validation[1], s.test[0]), "test": s.test}
        zone = {"train": 0, "gap_1": 1, "validation": 1, "gap_2": 2, "test": 2}
        cuts += [F.when(F.col("_i").between(a, b - 1), F.struct(F.lit(s.fold).alias("fold"), F.lit(p).alias("part"), F.lit(zone[p]).alias("zone"))) for p, (a, b) in ranges.items() if b > a]
    numbered = base.select("t", (F.row_number().over(Window.orderBy("t")) - 1).alias("_i"))
    return numbered.select("t", F.explode(F.array_compact(F.array(*cuts))).alias("p")).select("t", "p.*")


def fold_features(wide: DataFrame, target: str, names: list[str], features: list[tuple[str, int]], splits: list[validation.Split], period: int, *, mode: str = "raw", limit: int = C.INTERPOLATE_LIMIT, window: int = C.DETREND_WINDOW, tau_minutes: float = C.LOWPASS_TAU_MINUTES, k: int = 1, starts: list[int] = ()) -> DataFrame:
    """fold, part, t, y and a column a feature, for the complete rows of train, validation and test."""
    base = wide.where(F.col(target).isNotNull())
    placed = parts_of(base, splits)
    long = preprocess.to_long(base, names)
    segments = axis.segment_ids(base.select("t"), period, starts=list(starts), out="exact")
    segments = axis.segment_ids(segments, period, tolerance=C.TOLERANT_STEP, starts=list(starts), out="tolerant")
    rows = long.join(segments, "t").withColumn("side", axis.gap_group(F.col("t"), list(starts))).join(placed, "t")
    filled = preprocess.forward_fill(rows, limit, ["fold", "part", "exact"])
    moved = preprocess.transform(filled, mode, window=window, tau_minutes=tau_minutes, k=k, causal=True, keys=["fold", "part", "tolerant"])
    wanted = sorted(set(features))
    lags = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in wanted]))
    source = moved.where("value is not null").select("fold", "zone", "side", "t", "variable", "value").withColumn("l", lags).where("l.v = variable")
    source = source.select("fold", "zone", "side", (F.col("t") + F.col("l.k") * period).alias("t"), F.concat_ws("__lag_", "variable", F.col("l.k").cast("string")).alias("f"), "value")
    columns = [f"{v}__lag_{k}" for v, k in wanted]
    matrix = source.groupBy("fold", "zone", "side", "t").pivot("f", columns).agg(F.first("value"))
    y = moved.where((F.col("variable") == target) & ~F.col("part").startswith("gap") & F.col("value").isNotNull()).select("fold", "zone", "side", "part", "t", F.col("value").alias("y"))
    return y.join(matrix, ["fold", "zone", "side", "t"]).dropna(subset=columns).select("fold", "part", "t", "y", *[F.col(f"`{c}`") for c in columns])


def fit_models(rows: DataFrame, models: dict[str, list[str]], settings: Settings) -> DataFrame:
    """METRICS for every fold and model; models: name and columns."""
    names = F.explode(F.array(*[F.lit(m) for m in models]))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > FIT_ROWS:
            raise ValueError(f"{len(part)} rows in a fold: fit them with boosted_folds")
        part = part.sort_values("t")
        model = part["model"].iloc[0]
        x, y = part[models[model]].to_numpy(float), part["y"].to_numpy(float)
        train, valid, test = (part["part"].to_numpy() == p for p in ("train", "validation", "test"))
        row = {"fold": part["fold"].iloc[0], "model": model, "train_rows": int(train.sum()), "validation_rows": int(valid.sum()), "test_rows": int(test.sum())}
        if min(train.sum() - MIN_ROWS["train"], valid.sum() - MIN_ROWS["validation"], test.sum() - MIN_ROWS["test"]) < 0:
            return pd.DataFrame([row | {"best_iteration": None, "rmse": None, "mae": None, "r2": None}]).astype({"best_iteration": "Int32", "rmse": "Float64", "mae": "Float64", "r2": "Float64"})
        guess, last = boosted(x[train], y[train], x[valid], y[valid], x[test], settings)
        off = y[test] - guess
        spread = float(((y[test] - y[test].mean()) ** 2).sum())
        r2 = 1 - float(off @ off) / spread if spread else float(not (off @ off))
        return pd.DataFrame([row | {"best_iteration": last, "rmse": float(np.sqrt(np.mean(off**2))), "mae": float(np.abs(off).mean()), "r2": r2}])

    return rows.withColumn("model", names).groupBy("fold", "model").applyInPandas(fit, METRICS)


def validate(wide: DataFrame, target: str, pool: DataFrame, controls: list[str], max_lag: int, *, folds: int = 3, settings: Settings = Settings(), resample_seconds: int | None = None, starts: list[int] = (), **options) -> Validation:  # noqa: B008
    """pool: candidate_order, variable, screening_lag (12 rows at most). Status success, insufficient_rows or insufficient_features."""
    candidates = {r["variable"]: r["screening_lag"] for r in pool.orderBy("candidate_order").collect()}  # stages.MOST_CANDIDATES rows
    if resample_seconds:
        wide = preprocess.to_wide(axis.resample(preprocess.to_long(wide, [c for c in wide.columns if c != "t"]), resample_seconds), [c for c in wide.columns if c != "t"])
    period = axis.first_step(wide.select("t")).first()["period"] or 1
    used = {v: lag for v, lag in candidates.items() if v in wide.columns and v != target}
    controls = [c for c in dict.fromkeys(controls) if c in wide.columns and c != target]
    sets = validation.feature_sets(used, controls, target, max_lag)
    own = {v: [f for f in sets["m2"] if f[0] == v and f not in sets["m1"]] for v in used}
    n = wide.where(F.col(target).isNotNull()).count()
    name = lambda fs: [f"{v}__lag_{k}" for v, k in fs]
    gap = max(k for _, k in sets["m2"])
    splits = validation.expanding_splits(n, folds=folds, gap=gap)
    rows = stored(fold_features(wide, target, list(dict.fromkeys([target, *controls, *used])), sets["m0"] + sets["m2"], splits, period, starts=starts, **options))
    models = {"M0": name(sets["m0"]), "M1": name(sets["m1"]), "M2": name(sets["m2"])} | {f"CANDIDATE {v}": name(sets["m1"] + fs) for v, fs in own.items() if fs}
    fitted = stored(fit_models(rows, models, settings))
    short = fitted.where("rmse is null").limit(1).count()
    metrics = fitted.where("model in ('M0', 'M1', 'M2')")
    candidate = stages.candidate_uplift(fitted.where("model like 'CANDIDATE %'").withColumn("variable", F.expr("substring(model, 11)")), metrics.where("model = 'M1'"))
    order = pool.select("variable", "candidate_order")
    uplift = stages.ordered_uplift(validation.uplift_summary(candidate), order)
    status = "insufficient_rows" if short else "success" if any(own.values()) else "insufficient_features"
    return Validation(status, splits, rows, metrics, stages.model_summary(metrics), candidate, uplift, stages.fingerprint(rows, name(sets["m2"])), (rows, fitted))
