"""Out-of-time validation: expanding folds, feature lags, metrics and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASELINE_LAGS = (1, 2, 5, 10, 30, 60)


@dataclass(frozen=True)
class Split:
    fold: int
    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]


def expanding_splits(n: int, folds: int = 3, gap: int = 0, fraction: float = 0.15, min_train: int = 100, min_validation: int = 30, min_test: int = 30) -> list[Split]:
    """Row ranges [start, end): equal test blocks at the end, a validation block and gaps before each; too few rows are errors."""
    if n <= 0 or folds < 1 or gap < 0 or not 0 < fraction < 1:
        raise ValueError("bad split settings")
    size = n // (folds + 1)
    if size < min_test:
        raise ValueError(f"{size} test rows are fewer than {min_test}")
    out = []
    for i in range(folds):
        test = n - (folds - i) * size
        end = n if i == folds - 1 else test + size
        v1 = test - gap
        v0 = v1 - max(min_validation, int(v1 * fraction))
        if v0 - gap < min_train:
            raise ValueError(f"{max(0, v0 - gap)} training rows in fold {i} are fewer than {min_train}")
        out.append(Split(i, (0, v0 - gap), (v0, v1), (test, end)))
    return out


def split_table(spark: SparkSession, splits: list[Split]) -> DataFrame:
    rows = [(s.fold, p, *getattr(s, p)) for s in splits for p in ("train", "validation", "test")]
    return spark.createDataFrame(rows, "fold int, partition string, start long, stop long")


def fold_rows(df: DataFrame, splits: list[Split]) -> DataFrame:
    """df (t, ...) once for each fold and partition that its row is in; a few literal ranges, no join."""
    i = F.row_number().over(Window.orderBy("t")) - 1
    parts = [F.when(F.col("_i").between(a, b - 1), F.struct(F.lit(s.fold).alias("fold"), F.lit(p).alias("partition"))) for s in splits for p, (a, b) in (("train", s.train), ("validation", s.validation), ("test", s.test))]
    return df.withColumn("_i", i).withColumn("_p", F.explode(F.array_compact(F.array(*parts)))).select(*df.columns, "_p.fold", "_p.partition")


def fold_context(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold", "partition").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("rows"), ((F.max("t") - F.min("t")) / 60).alias("minutes"))


def positive_lags(lags: list[int], most: int) -> list[int]:
    return sorted({int(k) for k in lags if 1 <= int(k) <= most})


def candidate_lags(best: int, most: int, radius: int = 2) -> list[int]:
    return positive_lags(list(range(best - radius, best + radius + 1)), most) if best > 0 else []


def feature_sets(best: dict[str, int], controls: list[str], target: str, most: int) -> dict[str, list[tuple[str, int]]]:
    """(variable, lag) features: m0 the last target, m1 target and controls at fixed lags, m2 with each candidate around its best lag."""
    base = positive_lags(list(BASELINE_LAGS), most)
    m1 = [(v, k) for v in [target, *controls] for k in base]
    m2 = m1 + [(v, k) for v, lag in best.items() for k in candidate_lags(lag, most)]
    return {"m0": [(target, 1)], "m1": m1, "m2": m2}


def lag_features(wide: DataFrame, features: list[tuple[str, int]], period: int) -> DataFrame:
    """t and a column for each feature: the value exactly lag periods before (null without that time).

    One union and one aggregation by t, however many features there are.
    """
    by_variable: dict[str, list[int]] = {}
    for v, k in features:
        by_variable.setdefault(v, []).append(k)
    parts = [F.struct(F.lit(v).alias("v"), F.lit(k).alias("k"), F.col(v).cast("double").alias("x")) for v, ks in by_variable.items() for k in ks]
    moved = wide.select("t", F.inline(F.array(*parts))).select((F.col("t") + F.col("k") * period).alias("t"), F.concat_ws("__lag_", "v", F.col("k").cast("string")).alias("f"), "x")
    names = [f"{v}__lag_{k}" for v, k in features]
    return wide.select("t").join(moved.groupBy("t").pivot("f", names).agg(F.first("x", True)), "t", "left")


def fold_errors(predictions: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("actual") - F.col("predicted")
    out = predictions.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), F.var_pop("actual").alias("_v"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("_sse") / (F.col("_v") * F.col("rows")))).drop("_sse", "_v")


def uplift_status() -> Column:
    return (
        F.when(F.col("fold_count") == 0, "insufficient_features")
        .when((F.col("positive_rmse_fold_count") > 0) & (F.col("negative_rmse_fold_count") > 0) & (F.col("worst_fold_rmse_improvement_pct") < 0), "unstable_out_of_time")
        .when((F.col("fold_count") >= 2) & (F.col("positive_rmse_fold_ratio") >= 0.67) & (F.col("median_rmse_improvement_pct") > 0) & (F.col("median_mae_improvement_pct") >= 0), "validated_incremental_signal")
        .when(F.col("median_rmse_improvement_pct") > 0, "weak_incremental_value").otherwise("redundant_with_baseline")
    )


def uplift_summary(metrics: DataFrame) -> DataFrame:
    """Per variable, from (variable, fold, rmse_improvement_pct, mae_improvement_pct)."""
    r, m = F.col("rmse_improvement_pct"), F.col("mae_improvement_pct")
    g = metrics.groupBy("variable").agg(
        F.count(F.lit(1)).alias("fold_count"), F.count_if(r > 0).alias("positive_rmse_fold_count"), F.count_if(r < 0).alias("negative_rmse_fold_count"), F.count_if(m > 0).alias("positive_mae_fold_count"),
        F.median(r).alias("median_rmse_improvement_pct"), F.median(m).alias("median_mae_improvement_pct"), F.avg(r).alias("mean_rmse_improvement_pct"), F.avg(m).alias("mean_mae_improvement_pct"), F.min(r).alias("worst_fold_rmse_improvement_pct"),
    )
    g = g.withColumn("positive_rmse_fold_ratio", F.col("positive_rmse_fold_count") / F.col("fold_count"))
    return g.withColumn("validation_status", uplift_status())


def boosted_folds(rows: DataFrame, features: list[str], label: str, splits: list[Split], seed: int = 42, rounds: int = 20) -> DataFrame:
    """Gradient-boosted trees per fold: fold, rows, rmse, mae, r2 on the test block; the validation block stops early.

    For tables that no task holds: pyspark.ml splits every fit over the cluster. rounds bounds the trees.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    full = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.where(F.col(label).isNotNull()))
    parts = fold_rows(full, splits).persist()
    out = None
    for s in splits:
        fit = parts.where((F.col("fold") == s.fold) & F.col("partition").isin("train", "validation")).withColumn("_validation", F.col("partition") == "validation")
        model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, validationIndicatorCol="_validation").fit(fit)
        test = model.transform(parts.where((F.col("fold") == s.fold) & (F.col("partition") == "test")))
        scored = fold_errors(test.select("fold", F.col(label).alias("actual"), F.col("prediction").alias("predicted")), ["fold"])
        rows_of_fold = scored.collect()  # one row
        out = rows_of_fold if out is None else out + rows_of_fold
    parts.unpersist()
    return rows.sparkSession.createDataFrame(out, scored.schema)


def forest_importance(rows: DataFrame, features: list[str], label: str, seed: int = 42, trees: int = 250) -> DataFrame:
    """feature, importance of a random forest (impurity), the last quarter of time held out of the fit, the last fifth with fewer than 80 rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    w = Window.orderBy("t")
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.where(F.col(label).isNotNull()))
    placed = ready.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    model = RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=8, minInstancesPerNode=3, seed=seed).fit(placed.where("_i <= case when _n >= 80 then 0.75 else 0.8 end * _n"))
    return rows.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def variable_importance(importance: DataFrame) -> DataFrame:
    """Rolls features name__lag_k up to variables."""
    g = importance.withColumn("variable", F.regexp_replace("feature", r"__lag_\d+$", "")).groupBy("variable").agg(F.sum("importance").alias("total_importance"), F.max("importance").alias("max_importance"), F.count(F.lit(1)).alias("feature_count"), F.max_by("feature", "importance").alias("best_feature"))
    return g.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("total_importance"), F.desc("max_importance"), "variable")))
