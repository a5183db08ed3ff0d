"""Tails of Student's t and of F, by the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else math.nan


def corr_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation r of n pairs."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return math.nan
    if abs(r) >= 1 - 1e-12:
        return 0.0
    df = n - 2
    return t_two_sided(r * math.sqrt(df / (1 - r * r)), df)


def corr_p_value(r: Column, n: Column) -> Column:
    """corr_p as a column; null where it is undefined. A pandas function: Spark has no incomplete beta."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        out = np.array([corr_p(a, b) for a, b in zip(r.astype(float), n.astype(float), strict=True)], float)
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return p(r.cast("double"), n.cast("double"))
