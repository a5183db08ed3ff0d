"""All lags of whole series at once, in memory.

A series that fits one task (SERIES_ROWS rows) is shipped as an array, next to
the target's, to tasks that each score some of the lags: one shuffle of the
data, whatever the number of lags. Longer series go through the windows of
``association.pair_scores``, which spill; both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a series (16 bytes each) that one task holds, and that the target's array may have when it is broadcast.
SERIES_ROWS = 1_000_000
#: Lags that one task scores of one variable, if there are tasks enough.
LAGS_AT_ONCE = 48
SCORES = "variable string, lag int, n long, pearson double, spearman double"


def longest(long: DataFrame) -> int:
    """Rows of the longest series."""
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def correlation(x: np.ndarray, y: np.ndarray, least: int = 5) -> float | None:
    """Pearson's r; None with fewer than `least` pairs or a constant side."""
    if len(x) < least or (x == x[0]).all() or (y == y[0]).all():
        return None
    a, b = x - x.mean(), y - y.mean()
    size = float(np.sqrt((a @ a) * (b @ b)))
    return float(np.clip((a @ b) / size, -1.0, 1.0)) if size > 0 else None


class Lagged:
    """Pairs of one series with a target at any lag; ranks come from counts of each value, without sorting again."""

    def __init__(self, t: np.ndarray, x: np.ndarray, ty: np.ndarray, y: np.ndarray, period: int, starts: np.ndarray):
        self.t, self.x, self.ty, self.y, self.period = t, x, ty, y, period
        self.x_value, self.y_value = (np.unique(v, return_inverse=True)[1] for v in (x, y))
        self.x_side, self.y_side = (np.searchsorted(starts, v, "right") for v in (t, ty))

    def pairs(self, lag: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and y of the pairs whose times are exactly `lag` periods apart with no forced start between."""
        if not len(self.t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = self.ty - lag * self.period
        at = np.minimum(np.searchsorted(self.t, wanted), len(self.t) - 1)
        ok = (self.t[at] == wanted) & (self.x_side[at] == self.y_side)
        return at[ok], np.flatnonzero(ok)

    def score(self, lag: int) -> tuple[int, float | None, float | None]:
        """Number of pairs, Pearson's and Spearman's correlations."""
        i, j = self.pairs(lag)
        x, y = self.x[i], self.y[j]
        return len(i), correlation(x, y), correlation(average_ranks(self.x_value[i]), average_ranks(self.y_value[j]))


def average_ranks(value: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values sharing their mean; value: dense numbers in the order of the values."""
    counts = np.bincount(value) if len(value) else np.zeros(0, np.int64)
    return (np.cumsum(counts) - (counts - 1) / 2)[value]


def arrays(rows: DataFrame, key: str = "variable") -> DataFrame:
    """key, s: its known (t, value) in the order of t."""
    known = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))


def unpacked(column: pa.ListArray, at: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column[at].values
    return np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), float)


def series_scores(long: DataFrame, target: str, lags: list[int], period: int, starts: list[int] = (), targets: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """SCORES for every variable but the target and every lag with pairs; series of SERIES_ROWS at most.

    targets: the target's times that count; with group, a column of targets, each of its few values is scored on its own.
    """
    y = long.where(F.col("variable") == target).select("t", "value")
    y = y.withColumn("part_of", F.lit("")) if targets is None else y.join(targets.select("t", (F.lit("") if group is None else F.col(group)).alias("part_of")), "t")
    one = arrays(y, "part_of").select("part_of", F.col("s").alias("y"))
    x = arrays(long.where(F.col("variable") != target)).crossJoin(F.broadcast(one))  # one series, dealt to its groups
    spread = max(1, -(-len(lags) // LAGS_AT_ONCE))
    tasks = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    if spread > 1:
        tasks = tasks.repartition("variable", "part")
    blocked = np.array(sorted(starts), np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, s, target_s, part, of = (batch.column(c) for c in ("variable", "s", "y", "part", "part_of"))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                pair = Lagged(*unpacked(s, i), *unpacked(target_s, i), period, blocked)
                out += [(name[i].as_py(), k, *pair.score(k), of[i].as_py()) for k in lags[part[i].as_py() :: spread]]
            out = [row for row in out if row[2]]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["variable", "lag", "n", "pearson", "spearman", "part_of"])

    found = tasks.select("variable", "s", "y", "part", "part_of").mapInArrow(each, f"{SCORES}, part_of string")
    return found.drop("part_of") if group is None else found.withColumnRenamed("part_of", group)
