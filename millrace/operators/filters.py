"""Row filters, exclusions and column admission.

Frames are wide (t, one column a variable) or long (t, variable, value); t is
whole seconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
}

#: Parts of names of derived quantities.
FORMULA_WORDS = ["单耗", "消耗", "比值", "ratio", "rate", "%", "百分比", "折算", "累计", "平均", "total", "consumption", "specific"]


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def window_mask(windows: list[dict], t: str = "t") -> Column:
    """In any of the closed windows [start, end]."""
    for w in windows:
        if set(w) != {"start", "end"} or w["start"] > w["end"]:
            raise ValueError(f"bad window: {w}")
    return any_of([F.col(t).between(w["start"], w["end"]) for w in windows])


def condition_mask(rules: list[dict]) -> Column:
    """Any rule {column, operator, value} holds; missing and non-finite values never match, whatever the operator."""
    parts = []
    for r in rules:
        if r["operator"] not in OPERATORS:
            raise ValueError(f"bad operator: {r['operator']}")
        c = F.col(r["column"]).cast("double")
        known = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        parts.append(F.coalesce(known & OPERATORS[r["operator"]](c, F.lit(float(r["value"]))), F.lit(False)))
    return any_of(parts)


def exclude(df: DataFrame, windows: list[dict] = (), rules: list[dict] = ()) -> DataFrame:
    return df.where(~(window_mask(list(windows)) | condition_mask(list(rules))))


def exclusion_stats(df: DataFrame, windows: list[dict] = (), rules: list[dict] = ()) -> DataFrame:
    """original, excluded, remaining, ratio, windows."""
    hit = window_mask(list(windows)) | condition_mask(list(rules))
    n = df.agg(F.count(F.lit(1)).alias("original"), F.count_if(hit).alias("excluded"))
    return n.select(
        "original", "excluded", (F.col("original") - F.col("excluded")).alias("remaining"),
        F.when(F.col("original") > 0, F.col("excluded") / F.col("original")).otherwise(F.lit(0.0)).alias("ratio"),
        F.lit(len(list(windows))).cast("long").alias("windows"),
    )


def gap_starts(df: DataFrame, excluded: Column) -> DataFrame:
    """t of the first kept row after each excluded run that has kept rows before it."""
    order = Window.orderBy("t")
    kept = ~excluded
    rows = df.select("t", kept.alias("kept"))
    rows = rows.withColumns({"was": F.lag("kept").over(order), "any": F.max("kept").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where("kept and not was and any").select("t")


def tercile_segment(df: DataFrame, column: str, segment: str = "all", low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows of a load segment; both ends belong to it, so a bound's rows are in two segments."""
    if segment == "all":
        return df
    if segment == "custom":
        return df.where(F.col(column).between(low, high))
    q = df.agg(F.percentile(column, F.lit(1 / 3)).alias("_q1"), F.percentile(column, F.lit(2 / 3)).alias("_q2"))
    inside = {"low": F.col(column) <= F.col("_q1"), "mid": F.col(column).between(F.col("_q1"), F.col("_q2")), "high": F.col(column) >= F.col("_q2")}[segment]
    return df.join(F.broadcast(q)).where(inside).drop("_q1", "_q2")  # one row


def lag_sources(t: DataFrame, targets: DataFrame, max_lag: int, period: int) -> DataFrame:
    """Rows of t that some target could read at a lag of 1..max_lag periods."""
    wanted = targets.select("t", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("k")).select((F.col("t") - F.col("k") * period).alias("t")).distinct()
    return t.join(wanted, "t", "left_semi")


def column_admission(long: DataFrame, rows: int | Column, min_valid: float, protected: list[str] = ()) -> DataFrame:
    """variable, valid_ratio, distinct_values, admitted; rows: of the frame."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    known = long.groupBy("variable").agg((F.count("value") / rows).alias("valid_ratio"), F.countDistinct("value").alias("distinct_values"))
    safe = F.col("variable").isin(list(protected)) if protected else F.lit(False)
    return known.withColumn("admitted", (F.col("distinct_values") > 0) & (safe | ((F.col("valid_ratio") >= min_valid) & (F.col("distinct_values") > 1))))


def drop_columns(df: DataFrame, columns: list[str], protected: list[str]) -> DataFrame:
    """df without columns; unknown and protected ones are errors."""
    wanted = list(dict.fromkeys(columns))
    if unknown := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}")
    if kept := [c for c in wanted if c in protected]:
        raise ValueError(f"columns in use: {kept}")
    return df.drop(*wanted)


def ignore_roles(df: DataFrame, roles: dict[str, str], target: str) -> DataFrame:
    return df.drop(*[c for c, r in roles.items() if r == "IGNORE" and c != target and c in df.columns])


def control_reference(variable: Column) -> Column:
    """pid_output for names ending in .MV (any separator), pid_setpoint for .SP and .SV, else null."""
    suffix = F.upper(F.regexp_extract(variable, r"(?i)[._:-](SV|SP|MV)$", 1))
    return F.when(suffix == "MV", "pid_output").when(suffix != "", "pid_setpoint")


def formula_like(variable: Column) -> Column:
    return F.lower(variable).rlike("|".join(FORMULA_WORDS))


def with_risk_flags(df: DataFrame, wanted: list[str], column: str = "risk_flags") -> DataFrame:
    """Rows whose flags (joined by ;) contain any of wanted."""
    return df.where(any_of([F.col(column).contains(w) for w in wanted]))
