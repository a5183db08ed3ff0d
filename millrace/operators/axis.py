"""The time axis: sample period, segments, physical lags, resampling.

t is whole seconds. Windows are partitioned by variable where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_by_t(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("t") if keys else Window.orderBy("t")


def sample_period(times: DataFrame) -> DataFrame:
    """One row, period: the commonest positive step of t, the smallest of equally common ones."""
    step = (F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("period")
    counts = times.select("t").distinct().select(step).where("period > 0").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("period", F.struct((-F.col("n")).alias("n"), "period")).alias("period"))


def first_step(times: DataFrame) -> DataFrame:
    """One row, period: the first positive step, which later rows can't change."""
    step = (F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("period")
    return times.select("t").distinct().select("t", step).where("period > 0").agg(F.min_by("period", "t").alias("period"))


def median_step(times: DataFrame) -> DataFrame:
    step = (F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("step")
    return times.select("t").distinct().select(step).where("step > 0").agg(F.median("step").alias("period"))


def segment_ids(df: DataFrame, period: int, *, tolerance: float | None = None, starts: list[int] = (), keys: list[str] = (), out: str = "segment") -> DataFrame:
    """Number segments from 0. A new one begins where the step is not the period (or exceeds tolerance
    periods, if given), and at every forced start."""
    w = order_by_t(list(keys))
    step = F.col("t") - F.lag("t").over(w)
    broken = (step > tolerance * period) if tolerance else (step != period)
    if starts:
        broken = broken | F.col("t").isin(list(starts))
    return df.withColumn("_b", F.coalesce(broken & step.isNotNull(), F.lit(False)).cast("int")).withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def gap_group(t: Column, starts: list[int]) -> Column:
    """How many forced starts lie at or before t; only those block a lag."""
    if not starts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(int(s)).cast("long") for s in sorted(starts)]), lambda s: s <= t))


def lagged_pairs(long: DataFrame, target: str, lags: list[int] | DataFrame, period: int, starts: list[int] = (), targets: DataFrame | None = None) -> DataFrame:
    """variable, lag, t, x, y: target y at t with the variable's value exactly lag periods before.

    An equi-join on the shifted time: lags are physical, never row shifts. lags: a list for all
    variables, or a table (variable, lag) of the wanted ones, so that no others are made.
    """
    y = long.where(F.col("variable") == target).select("t", F.col("value").alias("y")).where("y is not null")
    if targets is not None:
        y = y.join(targets.select("t"), "t", "left_semi")
    x = long.where((F.col("variable") != target) & F.col("value").isNotNull()).select("variable", F.col("t").alias("s"), F.col("value").alias("x"))
    if isinstance(lags, DataFrame):
        x = x.join(lags.select("variable", "lag"), "variable")
    else:
        x = x.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
    x = x.withColumn("t", F.col("s") + F.col("lag") * period)
    pairs = x.join(y, "t")
    if starts:
        pairs = pairs.where(gap_group(F.col("s"), list(starts)) == gap_group(F.col("t"), list(starts)))
    return pairs.select("variable", "lag", "t", "x", "y")


def resample(long: DataFrame, width: int, origin: int | None = None) -> DataFrame:
    """Median per bin of `width` seconds from the first day's midnight (or origin); empty bins are null rows."""
    start = long.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    base = (F.col("lo") - F.pmod("lo", F.lit(86400))) if origin is None else F.lit(origin)
    first = F.col("base") + F.floor((F.col("lo") - F.col("base")) / width) * width
    spine = start.withColumn("base", base).select(F.col("base"), F.explode(F.sequence(first, F.col("hi"), F.lit(width).cast("long"))).alias("t"))
    bins = long.join(F.broadcast(start.withColumn("base", base).select("base")))  # one row
    bins = bins.groupBy((F.col("base") + F.floor((F.col("t") - F.col("base")) / width) * width).alias("t"), "variable").agg(F.median("value").alias("value"))
    names = long.select("variable").distinct()
    return spine.select("t").crossJoin(F.broadcast(names)).join(bins, ["t", "variable"], "left").select("t", "variable", "value")  # names: one row a column


def resample_segments(long: DataFrame, width: int, segments: DataFrame) -> DataFrame:
    """The same inside each segment (t, segment), with bins from its first time."""
    s = long.join(segments.select("t", "segment"), "t")
    lo = segments.groupBy("segment").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    bins = s.join(lo, "segment").groupBy("segment", "variable", (F.col("lo") + F.floor((F.col("t") - F.col("lo")) / width) * width).alias("t")).agg(F.median("value").alias("value"))
    spine = lo.select("segment", F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("t"))
    names = long.select("variable").distinct()
    return spine.crossJoin(F.broadcast(names)).join(bins, ["segment", "t", "variable"], "left").select("segment", "t", "variable", "value")


def downsample(df: DataFrame, most: int) -> DataFrame:
    """At most `most` rows at the places int(i * (n - 1) / (most - 1))."""
    w = Window.orderBy("t")
    numbered = df.withColumn("_i", F.row_number().over(w) - 1)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    places = n.select(F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("i"), "n").select(
        F.when(F.col("n") <= most, F.col("i")).otherwise(F.floor(F.col("i") * (F.col("n") - 1) / F.lit(most - 1))).cast("int").alias("_i")
    ).distinct()
    return numbered.join(F.broadcast(places), "_i", "left_semi").drop("_i")  # at most `most` rows
