"""Table readers: delimited text, Parquet, spreadsheets, and time series out of them."""

from __future__ import annotations

import csv
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "GB18030")


def first_bytes(spark: SparkSession, path: str, n: int = 64 * 1024) -> bytes:
    """The first n bytes of a file (or of a folder's first file), wherever Spark can read it; no more are read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    if not files:
        return b""
    stream = fs.open(files[0].getPath())
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(head: bytes, encoding: str) -> str:
    """The delimiter of a text file, by its head."""
    try:
        return csv.Sniffer().sniff(head.decode(encoding, "ignore"), ",\t; |").delimiter
    except csv.Error:
        return ","


def find_encoding(head: bytes) -> str:
    try:
        head[: max(0, len(head) - 4)].decode("utf-8-sig")
        return "utf-8"
    except UnicodeDecodeError:
        return "GB18030"


def read_table(spark: SparkSession, path: str, encoding: str = "auto", columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """.csv, .tsv, .txt (delimiter found), .parquet, .xlsx and .xls (where openpyxl is installed)."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv", "txt"):
        head = first_bytes(spark, path) if encoding == "auto" or kind == "txt" else b""
        coding = find_encoding(head) if encoding == "auto" else encoding
        sep = {"csv": ",", "tsv": "\t"}.get(kind) or sniff(head, coding)
        df = spark.read.option("header", True).option("sep", sep).option("encoding", coding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    elif kind in ("xlsx", "xlsm", "xls"):
        df = read_spreadsheet(spark, path)
    else:
        raise ValueError(f"cannot read {path}: unknown kind of file")
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit else df


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, as text columns. A sheet is at most about a million rows and is read as one piece."""
    try:
        import io

        import openpyxl
    except ImportError as missing:
        raise RuntimeError("spreadsheets need openpyxl, which is not installed") from missing
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    rows = openpyxl.load_workbook(io.BytesIO(bytes(content)), read_only=True, data_only=True).worksheets[0].iter_rows(values_only=True)
    names = [str(c) for c in next(rows)]
    data = [[None if v is None else v.isoformat(" ") if isinstance(v, dt.datetime) else str(v) for v in r] for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def seconds_of(ts: Column) -> Column:
    """Whole seconds of a timestamp without time zone, from 1970; the session's zone plays no part."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def load_series(df: DataFrame, time_column: str, order: str | None = None) -> DataFrame:
    """df with t (whole seconds) for time_column: unparsable times go, of equal times the last row (by order) stays."""
    order = order or time_column
    ts = F.col(time_column).try_cast("timestamp_ntz") if dict(df.dtypes)[time_column] != "timestamp_ntz" else F.col(time_column)
    rows = df.withColumn("_o", F.col(order) if order != time_column else F.monotonically_increasing_id()).withColumn("_ts", ts).where("_ts is not null")
    last = F.row_number().over(Window.partitionBy("_ts").orderBy(F.desc("_o")))
    return rows.withColumn("_r", last).where("_r = 1").withColumn("t", seconds_of(F.col("_ts"))).drop("_r", "_o", "_ts", time_column)


def duplicate_times(df: DataFrame, time_column: str) -> DataFrame:
    """One row, duplicate_timestamps: rows beyond the first of each time; unparsable times count as one time."""
    ts = F.coalesce(F.col(time_column).try_cast("timestamp_ntz").cast("string"), F.lit("?"))
    return df.agg((F.count(F.lit(1)) - F.countDistinct(ts)).alias("duplicate_timestamps"))


def numeric_columns(df: DataFrame, share: float = 0.7, sample: int = 5000) -> list[str]:
    """Columns of whose first `sample` rows at least `share` are numbers."""
    head = df.limit(sample)
    row = head.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull().cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (row[c] or 0) >= share]


def time_column(df: DataFrame, sample: int = 5000) -> str | None:
    """A column named like a time, or else one whose first rows are nearly all times in order."""
    names = [c for c in df.columns if any(k in c.lower() for k in ("time", "date", "timestamp", "时间", "日期"))]
    if names:
        return names[0]
    for c in df.columns:
        ts = F.col(f"`{c}`").cast("string").try_cast("timestamp_ntz")
        rows = df.limit(sample).select(ts.alias("ts"), F.monotonically_increasing_id().alias("i"))
        step = rows.withColumn("up", F.col("ts") >= F.lag("ts").over(Window.orderBy("i")))
        r = step.agg(F.avg(F.col("ts").isNotNull().cast("double")).alias("known"), F.avg(F.col("up").cast("double")).alias("up")).first()
        if (r["known"] or 0) >= 0.95 and (r["up"] or 0) >= 0.95:
            return c
    return None


def numeric_frame(df: DataFrame, target: str, least: int = 10) -> DataFrame:
    """All columns but t as numbers; a target with fewer than `least` of them is an error."""
    out = df.select("t", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns if c != "t"])
    n = out.agg(F.count(target)).first()[0]
    if n < least:
        raise ValueError(f"{target} has {n} numbers; {least} are needed")
    return out
