"""Column expressions that do not fail under ANSI mode: correlations, clipping, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = F.lit


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clip(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(x)))


def safe_div(a: Column | str, b: Column | str, otherwise: float | None = None) -> Column:
    a, b = as_col(a), as_col(b)
    return F.when((b != 0) & b.isNotNull(), a / b).otherwise(F.lit(otherwise).cast("double"))


def finite(x: Column | str) -> Column:
    """x, or null where it is NaN or infinite."""
    x = as_col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_corr(x: Column | str, y: Column | str, least: int = 5) -> Column:
    """Pearson correlation as an aggregate; null with fewer than `least` pairs or a constant side."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    enough = (F.count(a) >= least) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    # sums of squares about the mean; corr() itself divides by zero on constant sides
    return F.when(enough, clip(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), -1.0, 1.0))
