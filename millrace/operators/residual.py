"""Association after control variables are regressed out.

Target and candidate are regressed on the controls over the rows in which all of them
are known; all lags of the two residuals are scanned. One candidate is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .association import best_lags, peak_quality, with_squares
from .causality import side_by_side
from .series import Lagged

ROWS = "variable string, residual_status string, control_count int, control_matrix_rank int, condition_number double, joint_n long, lag int, n long, pearson double, spearman double"
NONE = {"lag": None, "n": None, "pearson": None, "spearman": None}


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What of y the columns of x leave; zero where it is rounding only."""
    left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return np.where(np.abs(left) <= 1e-12 * max(1.0, float(np.abs(y).max())), 0.0, left)


def residual_scores(long: DataFrame, target: str, controls: list[str], max_lag: int, period: int, starts: list[int] = (), targets: DataFrame | None = None) -> DataFrame:
    """ROWS for each candidate: one with a null lag that has its status, and one for each lag of its residuals.

    Status: control_reference_not_residualized, no_valid_controls, insufficient_joint_samples, rank_deficient or ok.
    """
    names = list(dict.fromkeys(c for c in controls if c != target))
    columns = [f"c{i}" for i in range(len(names))]
    blocked = np.array(sorted(starts), np.int64)
    rows = side_by_side(long, target, names).where(F.col("y").isNotNull() | F.col("x").isNotNull())
    if targets is not None:
        rows = rows.join(targets.select("t"), "t", "left_semi")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        row = {"variable": part["variable"].iloc[0], "residual_status": "no_valid_controls", "control_count": 0, "control_matrix_rank": None, "condition_number": None, "joint_n": 0} | NONE
        varied = lambda frame, cs: [c for c in cs if frame[c].nunique() > 1]
        used = varied(part, columns)
        known = part.dropna(subset=["x", "y", *used])
        used = varied(known, used)
        if not used:
            return table([row])
        row |= {"control_count": len(used), "joint_n": len(known)}
        if len(known) < max(10, max_lag + 5):
            return table([row | {"residual_status": "insufficient_joint_samples"}])
        design = np.column_stack([np.ones(len(known)), known[used].to_numpy(float)])
        rank, condition = int(np.linalg.matrix_rank(design)), float(np.linalg.cond(design))
        row |= {"residual_status": "ok" if rank == design.shape[1] else "rank_deficient", "control_matrix_rank": rank, "condition_number": condition if np.isfinite(condition) else None}
        t = known["t"].to_numpy(np.int64)
        pair = Lagged(t, fitted(design, known["x"].to_numpy(float)), t, fitted(design, known["y"].to_numpy(float)), period, blocked)
        found = [row | dict(zip(("lag", "n", "pearson", "spearman"), (k, *pair.score(k)), strict=True)) for k in range(-max_lag, max_lag + 1)]
        return table([row, *(r for r in found if r["n"])])

    def table(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(found).astype({"control_matrix_rank": "Int32", "lag": "Int32", "n": "Int64", "condition_number": "Float64", "pearson": "Float64", "spearman": "Float64"})

    scored = rows.groupBy("variable").applyInPandas(scan, ROWS)
    if not names:
        return scored
    kept = long.where(F.col("variable").isin(names)).select("variable").distinct()
    nulls = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ROWS.split(", ")[2:]}
    return scored.unionByName(kept.withColumns({"residual_status": F.lit("control_reference_not_residualized"), **nulls}))


def residual_corr(scores: DataFrame, max_lag: int) -> DataFrame:
    """One row a candidate from residual_scores: status, rank, condition number, best lag, its correlation and quality."""
    status = scores.where("lag is null").drop("lag", "n", "pearson", "spearman")
    lags = with_squares(scores.where("lag is not null").select("variable", "lag", "n", "pearson", "spearman"), max_lag)
    best = best_lags(lags).select(
        "variable", F.col("lag").alias("residual_lag"), F.col("score").alias("residual_corr"), F.col("signed").alias("residual_signed_corr"), F.col("method").alias("residual_method"),
        F.col("direction").alias("residual_direction"), F.col("n").alias("best_n"), F.col("boundary").alias("residual_lag_boundary_flag"),
    )
    quality = peak_quality(lags, max_lag).select("variable", F.col("lag_quality").alias("residual_lag_quality"))
    out = status.join(best, "variable", "left").join(quality, "variable", "left")
    lost = F.col("residual_lag").isNull() & F.col("residual_status").isin("ok", "rank_deficient")
    named = F.when(lost & (F.col("residual_status") == "ok"), "no_valid_residual_lag").when(lost, "rank_deficient_no_valid_residual_lag").otherwise(F.col("residual_status"))
    return out.withColumns({"residual_status": named, "residual_n": F.coalesce("best_n", "joint_n")}).drop("best_n", "joint_n")
