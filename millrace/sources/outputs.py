"""Result folders: versioned tables with an atomic pointer, single-file CSV exports, optional readers and checks.

All files go through Hadoop's file systems, so a folder can be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that export_csv brings to the driver; result tables have a row a variable or a lag of one.
EXPORT_ROWS = 1_000_000


# ------------------------------------------------------------------ files
def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: under another name first, which then replaces the old one."""
    jvm = spark.sparkContext._jvm
    final, fs = file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex[:8]}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if there is none."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


# ------------------------------------------------------------------ versions
def publish(tables: dict[str, DataFrame], folder: str, about: dict | None = None) -> str:
    """Writes all tables into a new version and then points CURRENT at it: readers see all or none."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    write_text(spark, f"{folder}/{version}/tables.json", json.dumps({"version": version, "tables": sorted(tables), "about": about or {}}))
    rollback(folder, version, spark)
    return version


def current(folder: str, spark: SparkSession | None = None) -> dict | None:
    text = read_text(spark or SparkSession.active(), f"{folder}/CURRENT.json")
    return json.loads(text) if text else None


def rollback(folder: str, version: str, spark: SparkSession | None = None) -> None:
    """Points CURRENT at a version that was written before."""
    spark = spark or SparkSession.active()
    text = read_text(spark, f"{folder}/{version}/tables.json")
    if text is None:
        raise ValueError(f"no version {version}")
    write_text(spark, f"{folder}/CURRENT.json", text)


def read_optional(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the current version; None where the stage that writes it did not run (an empty table is an answer)."""
    now = current(folder, spark)
    return spark.read.parquet(f"{folder}/{now['version']}/{name}") if now and name in now["tables"] else None


def save_config(spark: SparkSession, folder: str, config: dict) -> None:
    write_text(spark, f"{folder}/run_config.json", json.dumps(config, indent=1, ensure_ascii=False))


def load_config(spark: SparkSession, folder: str) -> dict:
    text = read_text(spark, f"{folder}/run_config.json")
    if text is None:
        raise ValueError(f"{folder} has no run_config.json")
    return json.loads(text)


# ------------------------------------------------------------------ exports
def export_csv(df: DataFrame, path: str, most: int = EXPORT_ROWS) -> None:
    """One CSV file with a byte order mark, for spreadsheets; more than `most` rows are an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table as Parquet")
    write_text(df.sparkSession, path, "﻿" + rows.to_csv(index=False))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def summary(ranked: DataFrame, target: str, top: int = 15) -> str:
    """A Markdown report of a ranking: counts, the first rows, advice."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candidate_grade").isin("A", "B")).alias("good"), F.count_if(F.col("risk_level") == "strong").alias("strong")).first()
    rows = [r.asDict() for r in ranked.orderBy("driver_rank").limit(top).collect()]
    first = rows[:10]
    advice = []
    if first and sum("lag_boundary" in (r["risk_flags"] or "") for r in first) >= 0.3 * len(first):
        advice.append("Many best lags lie at the scan's border: scan further.")
    if not n["good"]:
        advice.append("No variable has grade A or B: look at the data and the lags before going on.")
    common = sum("common_capacity_driver" in (r["risk_flags"] or "") for r in first)
    if first and (common >= 3 or common >= 0.3 * len(first)):
        advice.append("Many candidates may only follow the load: use control variables.")
    columns = ["driver_rank", "variable", "lag", "final_score", "candidate_grade", "recommended_use", "risk_flags"]
    return f"# Screening of {target}\n\n{n['n']} variables, {n['good']} with grade A or B, {n['strong']} with strong risks.\n\n{markdown_table(rows, columns)}\n" + "".join(f"\n- {a}" for a in advice)


def residual_order(residual: DataFrame, ranked: DataFrame) -> DataFrame:
    """The residual table in the order of the ranking, then by variable."""
    return residual.join(ranked.select("variable", F.col("driver_rank").alias("_rank")), "variable", "left").orderBy(F.asc_nulls_last("_rank"), "variable").drop("_rank")


def bundle_errors(metrics: DataFrame, context: DataFrame, candidates: DataFrame, summary: DataFrame, models: list[str] = ("M0", "M1", "M2")) -> DataFrame:
    """Rows (rule, n) of broken rules of a validation bundle; empty if it is whole.

    metrics: fold, model, rows of the parts, rmse, mae; context: fold, partition, rows; candidates: variable, fold, the errors and
    their improvements; summary: variable, fold_count, positive_rmse_fold_count.
    """
    n = F.count(F.lit(1)).alias("n")
    rule = lambda name, df: df.agg(n).select(F.lit(name).alias("rule"), "n")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    parts = context.groupBy("fold").pivot("partition", ["train", "validation", "test"]).agg(F.first("rows"))
    wrong = F.lit(False)
    for p in ("train", "validation", "test"):
        wrong = wrong | (F.col(f"{p}_rows") > F.col(p)) | (F.col(f"{p}_rows") <= 0)
    again = candidates.groupBy("variable").agg(F.count(F.lit(1)).cast("long").alias("_n"), F.count_if(F.col("rmse_improvement_pct") > 0).alias("_up"))
    off = F.abs((F.col("baseline_rmse") - F.col("rmse")) / F.nullif("baseline_rmse", F.lit(0.0)) * 100 - F.col("rmse_improvement_pct")) > 1e-6
    checks = [
        rule("doubled metrics", metrics.groupBy("fold", "model").count().where("count > 1")),
        rule("doubled candidate metrics", candidates.groupBy("variable", "fold").count().where("count > 1")),
        rule("models missing in a fold", context.select("fold").distinct().crossJoin(metrics.sparkSession.createDataFrame([(m,) for m in models], "model string")).join(metrics, ["fold", "model"], "left_anti")),  # a row a fold and model
        rule("metrics without fold", metrics.join(context, "fold", "left_anti")),
        rule("candidate metrics without fold", candidates.join(context, "fold", "left_anti")),
        rule("row counts", metrics.join(parts, "fold").where(wrong)),
        rule("not finite", metrics.where(bad("rmse") | bad("mae") | (F.col("rmse") < 0) | (F.col("mae") < 0))),
        rule("improvements", candidates.where(F.coalesce(off, F.lit(True)))),
        rule("summary", summary.where("fold_count > 0").join(again, "variable", "full_outer").where(~(F.col("fold_count").cast("long").eqNullSafe(F.col("_n")) & F.col("positive_rmse_fold_count").cast("long").eqNullSafe(F.col("_up"))))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.where("n > 0")
