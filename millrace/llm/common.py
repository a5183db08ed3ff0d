"""Shared pieces: durable intermediate tables, word hashing, bounded samples,
distributed prefix sums and exact selection by histogram.

Rows of every table are addressed by value, never by position, so a lost
executor only means that its tasks run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import forget, shared_dir, tidy  # noqa: F401
from ..sources.staging import stored as durable  # noqa: F401

#: Bytes of text that one vectorised step of the hashing below handles.
CHUNK_BYTES = 1 << 20


# ------------------------------------------------------------------ tables
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_labels(labels: DataFrame, column: str, most: int, where: Column | None = None) -> DataFrame:
    """At most `most` rows (doc_id, label) of labels: one a doc_id, those with the smallest hashes.

    The bound is what allows callers to broadcast the result.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).dropna()
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)


def labelled_texts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """label, text of the documents in known (doc_id, label; a row a doc_id), as many rows as known at most.

    Of rows that share a doc_id, the one of the smallest text counts.
    """
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")


# ------------------------------------------------------------------ order
def bucketed_prefix(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, out: str, buckets: int = 0) -> DataFrame:
    """Add `out`: the sum of `value` up to and with each row, per group, in the order of (bucket, *order).

    Sums of buckets come first (one small row each), so no task ever holds a
    whole group: a window only spans one bucket of a group. With very many
    buckets their sums are summed the same way, in buckets of buckets.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    if buckets > 20_000:
        upper = bucketed_prefix(sums.withColumn("_upper", F.floor(F.col(bucket) / 1000)), groups, "_upper", [F.col(bucket)], "_sum", "_upto", buckets // 1000)
        before = upper.select(*groups, bucket, (F.col("_upto") - F.col("_sum")).alias("_before"))
    else:
        over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
        before = sums.withColumn("_before", F.sum("_sum").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    renamed = before.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate([*groups, bucket])], F.coalesce("_before", F.lit(0)).alias("_before"))
    on = F.lit(True)
    for i, g in enumerate([*groups, bucket]):
        on = on & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return (
        df.withColumn("_inner", F.sum(value).over(inner))
        .join(renamed, on)
        .withColumn(out, F.col("_inner") + F.col("_before"))
        .drop("_inner", "_before", *[f"_k{i}" for i in range(len(groups) + 1)])
    )


def kth_largest(df: DataFrame, column: str, k: int, buckets: int = 2048) -> float | None:
    """The k-th largest value of a double column, exactly: histograms of ever narrower ranges.

    Each round counts the rows of `buckets` equal ranges (a small result) and
    goes on in the range that holds the k-th; ties end it.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    for _ in range(12):
        if lo == hi:
            return lo
        step = (hi - lo) / buckets
        if step == 0 or lo + step == lo:
            break
        at = F.least(F.floor((F.col(column) - lo) / step), F.lit(buckets - 1))
        rows = df.where(F.col(column).between(lo, hi)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    top = df.where(F.col(column).between(lo, hi)).select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()
    return top[0]


# ------------------------------------------------------------------ hashing
_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

with np.errstate(over="ignore"):
    _SEP = np.zeros(256, bool)
    _SEP[[0x20, *range(0x09, 0x0E)]] = True
    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                full = np.full(size, base, np.uint64)
                full[0] = 1
                _POWERS[key] = np.cumprod(full)
    return _POWERS["up"], _POWERS["down"]


def byte_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, past the last, bytes, and each row's offsets in them (null: empty).

    A slice has about CHUNK_BYTES, or one longer row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of True that do not cross rows."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+."""
    return runs(~_SEP[data], offsets)


def chain(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values (len - k + 1 of them)."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(values) - k + 1), k, np.uint64)
        for j in range(k):
            out = out * np.uint64(_MULT) + values[j : j + len(out)]
        return mix(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct k-word shingles as 64-bit hashes; of fewer words, one for them all; none without words."""
    for first, last, data, offsets in byte_chunks(column):
        starts, ends, row = words(data, offsets)
        hashes = span_hashes(data, starts, ends, lower=True)
        chained = chain(hashes, k)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        for i in range(last - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield np.unique(chained[a : b - k + 1])
            elif b > a:
                yield chain(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signed(x: Iterable) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)
