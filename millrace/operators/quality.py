"""Data diagnostics and the data-quality score of each variable (long frames)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import POOR_QUALITY, QUALITY_REFERENCE, SEVERE_QUALITY
from ..functions.mathx import clip
from .filters import any_of


def longest_run(df: DataFrame, flag: Column, out: str) -> DataFrame:
    """variable and the length of the longest run of rows with flag, by time (gaps and islands)."""
    w = Window.partitionBy("variable")
    rows = df.select("variable", "t", flag.alias("f")).withColumn("g", F.row_number().over(w.orderBy("t")) - F.row_number().over(Window.partitionBy("variable", "f").orderBy("t")))
    return rows.where("f").groupBy("variable", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("variable").agg(F.max("n").alias(out))


def longest_constant_run(df: DataFrame, out: str) -> DataFrame:
    known = df.where("value is not null")
    w = Window.partitionBy("variable").orderBy("t")
    new = F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(0))
    rows = known.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("variable", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("variable").agg(F.max("n").alias(out))


def diagnostics(long: DataFrame) -> DataFrame:
    w = Window.partitionBy("variable").orderBy("t")
    rows = long.withColumn("d", F.abs(F.col("value") - F.lag("value").over(w)))
    known = long.where("value is not null")
    stats = known.groupBy("variable").agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"), F.median("value").alias("med"))
    mode = known.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("variable").agg((F.max("n") / F.sum("n")).alias("saturation_ratio"))
    mad = known.join(stats, "variable").groupBy("variable").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    limit = 10 * (F.col("q3") - F.col("q1"))
    jump = (F.col("q3") > F.col("q1")) & (F.col("d") > limit)
    out_z = (F.col("mad") > 1e-12) & (0.6745 * F.abs(F.col("value") - F.col("med")) / F.col("mad") > 6)
    base = rows.join(stats, "variable", "left").join(mad, "variable", "left").groupBy("variable").agg(
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_rate"),
        F.count("value").alias("known"), F.count_if(jump).alias("abnormal_jump_count"), F.count("d").alias("steps"), F.count_if(out_z).alias("outliers"),
    )
    runs = longest_run(long, F.col("value").isNull(), "longest_missing_run")
    same = longest_constant_run(long, "constant_run_max")
    return (
        base.join(mode, "variable", "left").join(runs, "variable", "left").join(same, "variable", "left")
        .select(
            "variable", "missing_rate", F.coalesce("longest_missing_run", F.lit(0)).alias("longest_missing_run"), F.coalesce("constant_run_max", F.lit(0)).alias("constant_run_max"), "abnormal_jump_count",
            F.when(F.col("steps") > 0, F.col("abnormal_jump_count") / F.col("steps")).otherwise(0.0).alias("abnormal_jump_ratio"),
            F.when(F.col("known") >= 10, F.col("outliers") / F.col("known")).otherwise(0.0).alias("robust_outlier_ratio"),
            F.coalesce("saturation_ratio", F.lit(0.0)).alias("saturation_ratio"),
        )
    )


def quality_score() -> Column:
    """Geometric mean of a half-life for each rate: 1/2 at its reference rate."""
    total = F.lit(0.0)
    for name, reference in QUALITY_REFERENCE.items():
        total = total + F.greatest(F.lit(0.0), F.coalesce(F.col(name), F.lit(0.0))) / reference
    return clip(F.exp(-math.log(2) * total / len(QUALITY_REFERENCE)))


def poor() -> Column:
    return any_of([F.coalesce(F.col(c), F.lit(0.0)) > v for c, v in POOR_QUALITY.items()])


def severe() -> Column:
    return any_of([F.coalesce(F.col(c), F.lit(0.0)) > v for c, v in SEVERE_QUALITY.items()])
