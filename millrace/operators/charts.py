"""Queries behind charts: trend statistics, histograms, scatter matrices, lag profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend_stats(long: DataFrame) -> DataFrame:
    g = long.groupBy("variable").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("known"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("median"))
    return g.withColumns({"span": F.col("hi") - F.col("lo"), "known_ratio": F.col("known") / F.col("rows")})


def histogram(long: DataFrame, most: int = 12) -> DataFrame:
    """variable, bin, n: min(most, ceil(sqrt(n))) bins, the last closed."""
    known = long.where("value is not null")
    s = known.groupBy("variable").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    s = s.withColumn("_bins", F.least(F.lit(most), F.ceil(F.sqrt("_n"))))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.col("_bins") - 1, F.floor((F.col("value") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.col("_bins"))))).otherwise(0)
    return known.join(s, "variable").groupBy("variable", at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def normal_curve(long: DataFrame, samples: int = 40) -> DataFrame:
    """variable, i, x, y: the normal density of each variable's mean and deviation at samples + 1 places of its range, as a share of the peak."""
    g = long.where("value is not null").groupBy("variable").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = g.where("_s > 0 and _lo < _hi").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / samples
    z = (F.col("x") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return rows.withColumn("x", x).withColumn("y", F.exp(-0.5 * z * z)).select("variable", "i", "x", "y")


def scatter_matrix(wide: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """x, y, t and values of each pair, complete rows only."""
    pairs = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).alias("x"), F.col(b).alias("y")) for a in rows for b in columns]
    return wide.select("t", F.inline(F.array(*pairs))).where("x is not null and y is not null")


def lag_profile(scores: DataFrame, variable: str) -> DataFrame:
    return scores.where(F.col("variable") == variable).select("lag", "n", "pearson", "spearman")
