"""Lagged association: scores of every lag, false-discovery control, best lags, peak shape, redundancy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOUNDARY_FACTOR, EVIDENCE_MARGIN, INNOVATION_RADIUS, NEAR_PEAK_RATIO, NEUTRAL_BAND, REDUNDANT_CORR
from ..functions.distributions import corr_p_value
from ..functions.mathx import clip, safe_corr
from . import series
from .axis import gap_group, lagged_pairs
from .preprocess import difference


def average_rank(column: str, keys: list[str]):
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2


def lag_scores(long: DataFrame, target: str, max_lag: int, period: int, *, lags: list[int] | None = None, starts: list[int] = (), targets: DataFrame | None = None, rows: int | None = None, group: str | None = None) -> DataFrame:
    """variable, lag, n, pearson, spearman, r2s and the boundary flag; ranks are those of each lag's own pairs.

    targets: the target's times (t) that count; group: a column of targets whose values are scored on their own.
    rows: a bound on the rows of a series, where it is known; else they are counted. Series that fit a task are scored in memory.
    """
    lags = list(range(-max_lag, max_lag + 1)) if lags is None else lags
    if (series.longest(long) if rows is None else rows) <= series.SERIES_ROWS:
        return with_squares(series.series_scores(long, target, lags, period, list(starts), targets, group), max_lag)
    pairs = lagged_pairs(long, target, lags, period, list(starts), targets)
    if group is None:
        return pair_scores(pairs, ["variable", "lag"], max_lag)
    return pair_scores(pairs.join(targets.select("t", group), "t"), ["variable", group, "lag"], max_lag)


def pair_scores(pairs: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Scores of pairs of any number."""
    ranked = pairs.withColumns({"rx": average_rank("x", keys), "ry": average_rank("y", keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))
    return with_squares(out, max_lag)


def with_squares(scores: DataFrame, max_lag: int) -> DataFrame:
    return scores.withColumns(
        {
            "abs_pearson": F.abs("pearson"), "abs_spearman": F.abs("spearman"),
            "pearson_r2": F.col("pearson") * F.col("pearson"), "spearman_r2": F.col("spearman") * F.col("spearman"),
            "boundary": F.abs("lag") == max_lag,
        }
    )


def with_p_values(scores: DataFrame) -> DataFrame:
    return scores.withColumns({"pearson_p": corr_p_value(F.col("pearson"), F.col("n")), "spearman_p": corr_p_value(F.col("spearman"), F.col("n"))})


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: list[str] = (), buckets: int = 64) -> DataFrame:
    """Adjusted p-values of each family; nulls stay null and do not count.

    Ranks are those of a bucket of values (cut at quantiles of the whole column) after the
    number of smaller ones, and the minimum over larger ranks is that of the bucket's own and of the buckets after it:
    windows hold a bucket, and besides them there is one row a family and bucket.
    """
    keys = list(family)
    cuts = df.agg(F.percentile_approx(p, F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])).alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_q", clip(p))  # one row
    rows = rows.withColumn("_bucket", F.when(F.col(p).isNull(), -1).otherwise(F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(p))))).drop("_cuts")
    count = rows.where("_bucket >= 0").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    count = count.select(*keys, "_bucket", F.sum("_n").over(whole).alias("_m"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    ranked = rows.alias("r").join(count.alias("c"), same, "left").select("r.*", "_m", "_before").withColumn("_rank", F.col("_before") + F.row_number().over(inside.orderBy("_q")))
    ranked = ranked.withColumn("_own", F.min(F.col("_q") * F.col("_m") / F.col("_rank")).over(inside.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)))
    least = ranked.where("_bucket >= 0").groupBy(*keys, "_bucket").agg(F.min("_own").alias("_least"))
    least = least.select(*keys, "_bucket", F.min("_least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    found = ranked.alias("r").join(least.alias("c"), same, "left").select("r.*", "_later")
    return found.withColumn(out, F.when(F.col(p).isNotNull(), F.least("_own", F.coalesce("_later", F.lit(1.0)), F.lit(1.0)))).drop("_q", "_m", "_rank", "_before", "_own", "_later", "_bucket")


def with_q_values(scores: DataFrame) -> DataFrame:
    """pearson_q and spearman_q; the p-values of both kinds are one family."""
    keys = [c for c in scores.columns if c in ("variable", "lag")]
    both = scores.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_p").alias("p")) for k in ("pearson", "spearman")])))
    wide = benjamini_hochberg(both, "p", "q").groupBy(*keys).pivot("kind", ["pearson", "spearman"]).agg(F.first("q"))
    return scores.join(wide.withColumnsRenamed({"pearson": "pearson_q", "spearman": "spearman_q"}), keys)


def supported(scores: DataFrame, keys: list[str] = ("variable",)) -> DataFrame:
    """Lags with at least half of the variable's most pairs, but no more than 20 and no fewer than 8."""
    most = F.max("n").over(Window.partitionBy(*keys))
    least = F.least(F.lit(20), F.greatest(F.lit(8), F.ceil(most * 0.5)))
    return scores.withColumn("_least", least).where("n >= _least").drop("_least")


def best_lags(scores: DataFrame, keys: list[str] = ("variable",)) -> DataFrame:
    """The lag of the highest score per variable; of ties the first scanned (the most negative lag)."""
    ranked = supported(scores, list(keys)).withColumn("score", F.greatest("abs_pearson", "abs_spearman")).where("score is not null")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "lag"))
    by_pearson = F.coalesce(F.col("abs_pearson") >= F.col("abs_spearman"), F.col("abs_pearson").isNotNull())
    out = ranked.withColumn("_first", first).where("_first = 1").drop("_first")
    return out.withColumns(
        {
            "method": F.when(by_pearson, "pearson").otherwise("spearman"),
            "signed": F.when(by_pearson, F.col("pearson")).otherwise(F.col("spearman")),
            "direction": F.when(F.col("lag") > 0, "variable_leads").when(F.col("lag") < 0, "target_leads").otherwise("synchronous"),
        }
    )


def peak_quality(scores: DataFrame, max_lag: int) -> DataFrame:
    """How sharp and how lonely each variable's best lag is, and which way it points."""
    ranked = supported(scores).withColumn("score", F.greatest("abs_pearson", "abs_spearman")).where("score is not null")
    w = Window.partitionBy("variable").orderBy(F.desc("score"), "lag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = ranked.withColumns({"best_lag": F.first("lag").over(w), "best_score": F.first("score").over(w)})
    apart = F.abs(F.col("lag") - F.col("best_lag"))
    near = F.col("score") >= F.col("best_score") * NEAR_PEAK_RATIO
    g = at.groupBy("variable").agg(
        F.first("best_lag").alias("best_lag"), F.first("best_score").alias("best_score"),
        F.avg(F.when(apart == 1, F.col("score"))).alias("nearby_score_mean"),
        F.max(F.when(apart > 1, F.col("score"))).alias("second_peak_score"),
        F.min(F.when(near, F.col("lag"))).alias("near_peak_lag_min"), F.max(F.when(near, F.col("lag"))).alias("near_peak_lag_max"),
        F.count_if(near).alias("near_peak_lag_count"),
    )
    top = F.greatest("best_score", F.lit(1e-12))
    g = g.withColumn("peak_sharpness", F.coalesce(F.greatest(F.lit(0.0), F.col("best_score") - F.col("nearby_score_mean")), F.lit(0.0)))
    g = g.withColumns({"local_sharpness": clip(F.col("peak_sharpness") / top), "peak_prominence": F.coalesce(clip((F.col("best_score") - F.col("second_peak_score")) / top), F.lit(0.0))})
    g = g.withColumn("shape_quality", clip(0.70 * F.col("peak_prominence") + 0.30 * F.least("peak_prominence", "local_sharpness")))
    g = g.withColumn("lag_boundary_flag", F.abs("best_lag") == max_lag)
    status = (
        F.when(F.col("near_peak_lag_min") > NEUTRAL_BAND, "variable_leads_supported")
        .when(F.col("near_peak_lag_max") < -NEUTRAL_BAND, "target_leads_supported")
        .when((F.col("near_peak_lag_min") == 0) & (F.col("near_peak_lag_max") == 0), "synchronous")
        .otherwise("direction_unresolved")
    )
    return g.withColumns({"lag_quality": clip(F.col("shape_quality") * F.when(F.col("lag_boundary_flag"), BOUNDARY_FACTOR).otherwise(1.0)), "temporal_direction_status": status})


def innovation(long: DataFrame, target: str, best: DataFrame, max_lag: int, period: int, keys: list[str] = (), starts: list[int] = (), targets: DataFrame | None = None) -> DataFrame:
    """Best lag of first differences within INNOVATION_RADIUS of the raw one, and whether both agree; its score counts only if they do.

    keys: columns of long that differences do not cross (segments).
    """
    wanted = best.select("variable", F.col("lag").alias("raw_lag"), F.col("signed").alias("raw_signed"))
    near = F.explode(F.sequence(F.greatest(F.col("raw_lag") - INNOVATION_RADIUS, F.lit(-max_lag)), F.least(F.col("raw_lag") + INNOVATION_RADIUS, F.lit(max_lag))))
    pairs = lagged_pairs(difference(long, 1, list(keys)), target, wanted.select("variable", near.alias("lag")), period, list(starts), targets)
    found = best_lags(pair_scores(pairs, ["variable", "lag"], max_lag)).select("variable", F.col("lag").alias("innovation_lag"), F.col("score").alias("_score"), F.col("signed").alias("innovation_signed"))
    lags_agree = (F.abs(F.col("innovation_lag") - F.col("raw_lag")) <= INNOVATION_RADIUS) & (F.signum("innovation_lag") == F.signum("raw_lag"))
    status = (
        F.when(F.col("innovation_lag").isNull(), "not_computed").when(~lags_agree, "innovation_lag_conflict").when(F.col("innovation_signed").isNull() | F.col("raw_signed").isNull(), "innovation_sign_unknown")
        .when(F.signum("innovation_signed") != F.signum("raw_signed"), "innovation_sign_conflict").otherwise("innovation_verified")
    )
    out = wanted.join(found, "variable", "left").withColumn("innovation_status", status).withColumn("innovation_verified", F.col("innovation_status") == "innovation_verified")
    return out.withColumn("innovation_score", F.when(F.col("innovation_verified"), F.col("_score"))).drop("_score")


def redundant_pairs(long: DataFrame, target: str, best: DataFrame | None = None, period: int = 1, starts: list[int] = (), least: int = 30, corr: float = REDUNDANT_CORR) -> DataFrame:
    """Pairs of other variables (a < b) with |r| >= corr on at least `least` common times.

    With best (variable, lag), only variables of a positive lag, each shifted by its own: what both say of the target's same time.
    """
    rows = long.where((F.col("variable") != target) & F.col("value").isNotNull()).select("t", "variable", "value")
    if best is not None:
        moved = rows.join(best.where("lag > 0").select("variable", "lag"), "variable").withColumn("s", F.col("t") + F.col("lag") * period)
        if starts:
            moved = moved.where(gap_group(F.col("t"), list(starts)) == gap_group(F.col("s"), list(starts)))
        rows = moved.join(long.select(F.col("t").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("t"), "variable", "value")
    a = rows.select("t", F.col("variable").alias("a"), F.col("value").alias("x"))
    b = rows.select("t", F.col("variable").alias("b"), F.col("value").alias("y"))
    out = a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("r"))
    return out.withColumn("redundant", F.coalesce((F.col("n") >= least) & (F.abs("r") >= corr), F.lit(False)))


def redundancy_groups(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """variable, group: connected components of the redundant pairs, named by the least variable; a row a name.

    Labels go along the edges until none changes: a group of k variables takes at most k rounds, a row a variable each.
    """
    edge = pairs.where("redundant").select("a", "b")
    both = edge.union(edge.select("b", "a")).toDF("a", "b").persist()
    label = names.select("variable", F.col("variable").alias("group"))
    while True:
        lowest = both.join(label.withColumnRenamed("variable", "b"), "b").groupBy(F.col("a").alias("variable")).agg(F.min("group").alias("low"))
        new = label.join(lowest, "variable", "left").select("variable", F.least("group", "low").alias("group"), (F.col("low") < F.col("group")).alias("moved"))
        rows = new.collect()  # a row a variable
        label = names.sparkSession.createDataFrame([(r["variable"], r["group"]) for r in rows], "variable string, group string")
        if not any(r["moved"] for r in rows):
            both.unpersist()
            return label


def redundant_variables(groups: DataFrame, profile: DataFrame, fields: list[str], margin: float = EVIDENCE_MARGIN) -> DataFrame:
    """variable, group, redundant: all of a group but the one whose evidence clearly exceeds that of every other; all, if there is none such.

    Clearly: by margin or more in some field, and by margin or more behind in none; absent values do not count.
    """
    p = groups.join(profile.select("variable", *fields), "variable", "left")
    sized = p.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    a, b = p.alias("a"), p.alias("b")
    gap = [F.col(f"a.{f}") - F.col(f"b.{f}") for f in fields]
    ahead = reduce(lambda x, y: x | y, [F.coalesce(g >= margin, F.lit(False)) for g in gap])
    behind = reduce(lambda x, y: x | y, [F.coalesce(g <= -margin, F.lit(False)) for g in gap])
    wins = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.variable") != F.col("b.variable"))).groupBy(F.col("a.variable").alias("variable")).agg(F.every(ahead & ~behind).alias("first"))
    out = p.select("variable", "group").join(sized, "group").join(wins, "variable", "left")
    return out.select("variable", "group", ((F.col("size") > 1) & ~F.coalesce("first", F.lit(False))).alias("redundant"))
