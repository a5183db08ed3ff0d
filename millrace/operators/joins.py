"""Joins with special rules: fill missing values, compare branches, match repeated keys, overlap of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def fill_missing(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: str, blank: bool = False) -> DataFrame:
    """left with nulls (and blanks) of columns filled from right's first row per key; absent columns are added."""
    r = first_per_key(right, key, order).select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = left.join(r, key, "left")
    for c in columns:
        own = F.col(c) if c in left.columns else F.lit(None)
        if blank and c in left.columns and dict(left.dtypes)[c] == "string":
            own = F.nullif(F.trim(own), F.lit(""))
        out = out.withColumn(c, F.coalesce(own, F.col(f"_{c}")))
    return out.drop(*[f"_{c}" for c in columns])


def compare_branches(raw: DataFrame, processed: DataFrame, top_k: int) -> DataFrame:
    """Full outer join of two rankings (variable, rank, lag, score): deltas, direction changes, top-k membership."""
    a = raw.select("variable", *[F.col(c).alias(f"raw_{c}") for c in ("rank", "lag", "score")])
    b = processed.select("variable", *[F.col(c).alias(f"processed_{c}") for c in ("rank", "lag", "score")])
    out = a.join(b, "variable", "full_outer")
    presence = F.when(F.col("raw_rank").isNull(), "processed_only").when(F.col("processed_rank").isNull(), "raw_only").otherwise("both")
    top = lambda c: F.coalesce(F.col(c) <= top_k, F.lit(False))
    change = F.when(F.signum("raw_lag") != F.signum("processed_lag"), True).otherwise(False)
    return out.withColumns(
        {
            "presence": presence, "score_delta": F.col("processed_score") - F.col("raw_score"), "lag_delta": F.col("processed_lag") - F.col("raw_lag"),
            "rank_delta": F.col("processed_rank") - F.col("raw_rank"), "direction_changed": change, "in_raw_top": top("raw_rank"), "in_processed_top": top("processed_rank"),
        }
    )


def occurrence_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Matches the i-th row of a key on the left with the i-th on the right."""
    place = lambda order: F.row_number().over(Window.partitionBy(key).orderBy(order))
    return left.withColumn("_i", place(left_order)).join(right.withColumn("_i", place(right_order)), [key, "_i"], "left").withColumnRenamed("_i", "occurrence")


def topk_overlap(one: DataFrame, other: DataFrame, ks: list[int]) -> DataFrame:
    """k, shared, entered, left: of the first k variables (rank, variable) of two rankings."""
    parts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    top = lambda d, side: d.select("variable", "rank", parts).where("rank <= k").select("k", "variable", F.lit(True).alias(side))
    both = top(one, "a").join(top(other, "b"), ["k", "variable"], "full_outer")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return both.groupBy("k").agg(F.count_if(a & b).alias("shared"), F.count_if(~a & b).alias("entered"), F.count_if(a & ~b).alias("dropped"))
