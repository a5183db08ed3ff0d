"""Granger tests, conditional tests and model lift: least squares per variable.

Each variable's regressions run in one task over its own (target, candidate,
controls) rows; variables are the parallel axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_tail
from .association import benjamini_hochberg


def ssr(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ beta
    return float(left @ left), int(rank)


def shifted(t: np.ndarray, v: np.ndarray, k: int, period: int) -> np.ndarray:
    """v at t - k periods, NaN where that time is absent."""
    at = np.searchsorted(t, t - k * period)
    at = np.minimum(at, len(t) - 1)
    return np.where(t[at] == t - k * period, v[at], np.nan)


def side_by_side(long: DataFrame, target: str, controls: list[str]) -> DataFrame:
    """variable, t, x, y and a column a control."""
    y = long.where(F.col("variable") == target).select("t", F.col("value").alias("y"))
    rows = long.where(~F.col("variable").isin(target, *controls)).select("variable", "t", F.col("value").alias("x")).join(y, "t")
    for i, c in enumerate(controls):
        rows = rows.join(long.where(F.col("variable") == c).select("t", F.col("value").alias(f"c{i}")), "t", "left")
    return rows


class LagScan:
    """Least squares of y on 1, its own lags 1..p and x's lags 1..p, for p = 1, 2, ... in turn.

    The products of all columns are kept and brought from p to p + 1: two columns are added
    (their products with all others are correlations, by Fourier transforms) and the rows that lack the
    new lags are taken out. One Cholesky factor, own lags first, gives both sums of squares. Where it is
    close to singular, or the fit nearly perfect, the columns are solved directly.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, period: int, most: int):
        at, off = np.divmod(t - t[0], period)
        self.regular = not off.any() and at[-1] < 4 * len(t) + most
        if not self.regular:  # times off the grid: lags by search, each kept as a column
            self.x, self.y = x, y
        else:
            self.x, self.y = (np.full(int(at[-1]) + 1, np.nan) for _ in range(2))
            self.x[at], self.y[at] = x, y
        scale = lambda v: (v - np.nanmean(v)) / (np.nanstd(v) or 1.0)
        self.x, self.y = scale(self.x), scale(self.y)
        if not self.regular:
            self.lags = {(w, k): shifted(t, v, k, period) for k in range(1, most + 1) for w, v in (("y", self.y), ("x", self.x))}
        n = len(self.y)
        self.zero = {"y": np.nan_to_num(self.y), "x": np.nan_to_num(self.x)}
        self.size = 1 << int(2 * n + 1).bit_length()
        self.waves = {w: np.fft.rfft(v, self.size) for w, v in self.zero.items()}
        self.names: list[tuple[str, int]] = []
        self.valid = np.isfinite(self.y)
        self.p = 0
        rows = self.valid.sum()
        self.gram = np.array([[float(rows)]])
        self.right = np.array([self.zero["y"].sum()])

    def column(self, name: tuple[str, int]) -> np.ndarray:
        """A lag's values, NaN where it is absent."""
        if not self.regular:
            return self.lags[name]
        out = np.full(len(self.y), np.nan)
        k = name[1]
        out[k:] = (self.y if name[0] == "y" else self.x)[: len(out) - k]
        return out

    def products(self, v: np.ndarray) -> np.ndarray:
        """The sums of v times 1 and each column so far; v is 0 outside valid rows."""
        if not self.names:
            return np.array([v.sum()])
        if not self.regular:
            return np.array([v.sum(), *(v @ np.nan_to_num(self.lags[c]) for c in self.names)])
        wave = np.fft.rfft(v, self.size)
        by = {w: np.fft.irfft(wave * np.conj(z), self.size) for w, z in self.waves.items()}
        return np.array([v.sum(), *(by[w][k] for w, k in self.names)])

    def advance(self) -> None:
        """From p to p + 1 lags."""
        self.p += 1
        new = [("y", self.p), ("x", self.p)]
        columns = [self.column(c) for c in new]
        kept = self.valid & np.isfinite(columns[0]) & np.isfinite(columns[1])
        gone = np.flatnonzero(self.valid & ~kept)
        if len(gone):
            out = np.ones((len(gone), 1 + len(self.names)))
            for j, (w, k) in enumerate(self.names):
                out[:, j + 1] = self.lags[w, k][gone] if not self.regular else self.zero[w][gone - k]
            self.gram -= out.T @ out
            self.right -= out.T @ self.zero["y"][gone]
        self.valid = kept
        for c, v in zip(new, columns, strict=True):
            v = np.where(kept, np.nan_to_num(v), 0.0)
            cross = self.products(v)
            self.gram = np.block([[self.gram, cross[:, None]], [cross[None, :], np.array([[v @ v]])]])
            self.right = np.append(self.right, v @ self.zero["y"])
            self.names.append(c)

    def solve(self) -> tuple[int, float, int, float, int, float, float]:
        """Rows; sum of squares and rank of the small and of the full model; the same sums for the first own lag alone and with x's last lag."""
        n, p = int(self.valid.sum()), self.p
        own = [0, *(1 + i for i, c in enumerate(self.names) if c[0] == "y")]
        order = [*own, *(1 + i for i, c in enumerate(self.names) if c[0] == "x")]
        y = self.zero["y"][self.valid]
        total = float(y @ y)
        gram, right = self.gram[np.ix_(order, order)], self.right[order]
        try:
            factor = np.linalg.cholesky(gram)
            z = np.linalg.solve(factor, right)
            small, full = total - float(z[: p + 1] @ z[: p + 1]), total - float(z @ z)
            sound = (np.diag(factor) ** 2).min() > 1e-9 * n and full > 1e-8 * total
        except np.linalg.LinAlgError:
            sound = False
        if not sound or n <= len(order):
            m = np.column_stack([np.ones(n), *(self.column(c)[self.valid] for c in self.names)])[:, order]
            (small, rank0), (full, rank1) = ssr(m[:, : p + 1], y), ssr(m, y)
        else:
            rank0, rank1 = p + 1, 2 * p + 1
        one = order[:2]
        last = [*one, order[-1]]
        part = lambda at: total - float(self.right[at] @ np.linalg.lstsq(self.gram[np.ix_(at, at)], self.right[at], rcond=None)[0])
        return n, small, rank0, full, rank1, part(one), part(last)


def granger(long: DataFrame, target: str, max_lag: int, period: int) -> DataFrame:
    """variable, lag, status, n, f, p, q, contribution: y on its own lags against those and x's, per lag order."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t, x, y = (part[c].to_numpy() for c in ("t", "x", "y"))
        scan = LagScan(t, x.astype(float), y.astype(float), period, max_lag)
        out = []
        for p in range(1, max_lag + 1):
            scan.advance()
            n = int(scan.valid.sum())
            row = (part["variable"].iloc[0], p)
            if n < max(30, 5 * max_lag):
                out.append((*row, "insufficient_rows", n, None, None, None))
                continue
            n, s0, r0, s1, r1, a, b = scan.solve()
            d1, d2 = r1 - r0, n - r1
            size = float((scan.zero["y"][scan.valid] ** 2).sum())
            if d1 <= 0 or d2 <= 0 or s1 <= 1e-12 * max(1.0, size):
                out.append((*row, "degenerate", n, None, None, None))
                continue
            f = max(0.0, (s0 - s1) / d1 / (s1 / d2))
            out.append((*row, "ok", n, f, f_tail(f, d1, d2), max(0.0, 1 - np.sqrt(max(b, 0.0) / a)) if n >= 10 and a > 0 else 0.0))
        return pd.DataFrame(out, columns=["variable", "lag", "status", "n", "f", "p", "contribution"]).astype({"f": "Float64", "p": "Float64", "contribution": "Float64"})

    tested = side_by_side(long, target, []).groupBy("variable").applyInPandas(test, "variable string, lag int, status string, n long, f double, p double, contribution double")
    return benjamini_hochberg(tested, "p", "q")


def conditional_granger(long: DataFrame, target: str, controls: list[str], max_lag: int, period: int, baseline: int = 3, min_rows: int = 60) -> DataFrame:
    """One candidate lag at a time beyond lags of the target and of the controls; null p above a condition number of 1e8."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t = part["t"].to_numpy()
        y, x = part["y"].to_numpy(float), part["x"].to_numpy(float)
        base = [shifted(t, v, k, period) for v in [y, *[part[f"c{i}"].to_numpy(float) for i in range(len(controls))]] for k in range(1, min(max_lag, baseline) + 1)]
        out = []
        for k in range(1, max_lag + 1):
            rows = np.column_stack([y, *base, shifted(t, x, k, period)])
            rows = rows[np.isfinite(rows).all(axis=1)]
            n = len(rows)
            if n < min_rows:
                out.append((part["variable"].iloc[0], k, "insufficient_rows", n, None, None, None, None))
                continue
            ones = np.ones((n, 1))
            small, full = np.hstack([ones, rows[:, 1:-1]]), np.hstack([ones, rows[:, 1:]])
            s0, _ = ssr(small, rows[:, 0])
            s1, r1 = ssr(full, rows[:, 0])
            cond = float(np.linalg.cond(full))
            contribution = 1 - np.sqrt(s1 / s0) if s0 > 0 else 0.0
            d2 = n - r1
            if cond > 1e8 or d2 <= 0 or s1 <= 0:
                out.append((part["variable"].iloc[0], k, "high_collinearity_risk", n, cond, None, None, contribution))
                continue
            f = max(0.0, (s0 - s1) / (s1 / d2))
            out.append((part["variable"].iloc[0], k, "ok", n, cond, f, f_tail(f, 1, d2), contribution))
        return pd.DataFrame(out, columns=["variable", "lag", "status", "n", "condition_number", "f", "p", "contribution"]).astype({c: "Float64" for c in ("condition_number", "f", "p", "contribution")})

    tested = side_by_side(long, target, controls).groupBy("variable").applyInPandas(test, "variable string, lag int, status string, n long, condition_number double, f double, p double, contribution double")
    return benjamini_hochberg(tested, "p", "q")


def model_lift(long: DataFrame, target: str, best: DataFrame, max_lag: int, period: int, folds: int = 4) -> DataFrame:
    """Out-of-fold gain of the candidate's lags around its best (and their squares) over an autoregression."""

    def lift(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        name, at = part["variable"].iloc[0], part["best"].iloc[0]
        row = {"variable": name, "status": "non_predictive_lag", "ar_baseline_rmse": None, "candidate_rmse": None, "model_lift": None, "median_fold_lift": None, "positive_fold_ratio": None, "model_lift_score": None}
        lags = [k for k in range(int(at) - 2, int(at) + 3) if 1 <= k <= max_lag] if at > 0 else []
        if lags:
            t, x, y = part["t"].to_numpy(), part["x"].to_numpy(float), part["y"].to_numpy(float)
            own = [shifted(t, y, k, period) for k in range(1, min(max_lag, 6) + 1)]
            other = [v for k in lags for v in (shifted(t, x, k, period), shifted(t, x, k, period) ** 2)]
            data = np.column_stack([y, *own, *other])
            data = data[np.isfinite(data).all(axis=1)]
            n, row["status"] = len(data), "skipped: insufficient rows"
            if n >= 60:
                size, base, full = max(5, n // (folds + 1)), [], []
                for f in range(folds):
                    a = n - (folds - f) * size
                    if a < max(10, size):
                        continue
                    for errors, width in ((base, len(own)), (full, data.shape[1] - 1)):
                        m = np.hstack([np.ones((n, 1)), data[:, 1 : width + 1]])
                        beta = np.linalg.lstsq(m[:a], data[:a, 0], rcond=None)[0]
                        errors.append(float(np.sqrt(np.mean((data[a : a + size, 0] - m[a : a + size] @ beta) ** 2))))
                row["status"] = "skipped: no valid time series split"
                if base:
                    gain = np.array([(b - c) / b if b > 0 else 0.0 for b, c in zip(base, full, strict=True)])
                    mb, mf = float(np.mean(base)), float(np.mean(full))
                    row |= {"status": "ok", "ar_baseline_rmse": mb, "candidate_rmse": mf, "model_lift": max(0.0, (mb - mf) / mb) if mb > 0 else 0.0, "median_fold_lift": float(np.median(gain)), "positive_fold_ratio": float((gain > 0).mean())}
                    row["model_lift_score"] = min(1.0, max(0.0, row["median_fold_lift"]) / 0.05) * row["positive_fold_ratio"]
        return pd.DataFrame([row]).astype({c: "Float64" for c in row if c not in ("variable", "status")})

    rows = side_by_side(long, target, []).join(best.select("variable", F.col("lag").alias("best")), "variable")
    return rows.groupBy("variable").applyInPandas(lift, "variable string, status string, ar_baseline_rmse double, candidate_rmse double, model_lift double, median_fold_lift double, positive_fold_ratio double, model_lift_score double")
