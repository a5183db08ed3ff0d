"""Embedding near-dedup by sorted projection passes.

Each pass gives every vector a 64-bit code, the concatenated signs of random
projections, and orders the vectors by it; each vector is compared with the
next `window` ones. Vectors of a small angle share long code prefixes, so they
end up near each other in some pass. A window does not hold a dense group that is
larger than it: vectors that share a code's first bits (a cell) are therefore all
compared with each other, in tiles, where a cell has more of them than a window.
The number of passes follows from the number of those bits, so that a pair at the
threshold shares a cell, and is met, with probability `recall`, however the
vectors lie. A cell of m vectors takes m * m / 2 comparisons.

Pairs are never listed: blocks of the order (overlapping by a window) and tiles
count each vector's links and emit a spanning forest. A pair that was compared
before is told by its ranks and cells there and counts once. Equal vectors
form a class first, known by a 64-bit hash, and only one of a class is compared.
Joins of rows with their class meet a large class on one key; Spark's adaptive skew join splits those.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do vectors of different lengths;
rows that share a vec_id but not the vector count as vectors of their own, in one
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget
from .components import components

WINDOW = 1024
BLOCK = 1024
TILE = 2048
STRIP = 256
RECALL = 0.999
CODE_BITS = 63


def cell_bits(n: int, window: int) -> int:
    """How many first bits of a code make a cell: spread-out vectors then fill a window at most."""
    return min(CODE_BITS, max(1, math.ceil(math.log2(max(2, n) / window))))


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """How many passes put a pair at the threshold into one cell with probability recall."""
    same_bit = 1 - math.acos(threshold) / math.pi
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - same_bit ** cell_bits(n, window))))


def codes(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """node, dims, code of each pass as an array."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = (np.uint64(1) << np.arange(CODE_BITS, dtype=np.uint64)[::-1]).astype(np.uint64)
        for batch in batches:
            nodes, lists = batch.column(0), batch.column(1)
            out = np.zeros((len(nodes), passes), np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), passes * CODE_BITS))
                x = np.asarray(lists.take(pa.array(at)).flatten(), float).reshape(len(at), d)
                signs = (x @ planes[d] > 0).reshape(len(at), passes, CODE_BITS)
                out[at] = (signs * weight).sum(axis=2, dtype=np.uint64).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(nodes) + 1) * passes, passes, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(sizes.astype(np.int32)), flat], ["node", "dims", "codes"])

    return vectors.select("node", "v").mapInArrow(each, "node long, dims int, codes array<long>")


def ranked(coded: DataFrame, spread: int, bits: int, window: int) -> tuple[DataFrame, DataFrame]:
    """A stored table to forget, and node, spots: of each pass, its place in the order (rank, from 0) and the first place (start) and size of its cell; start is -1 where windows hold the whole cell.

    One range sort serves all passes. Places come from the sizes of the sorted partitions, a number each.
    """
    rows = coded.select("node", "dims", F.posexplode("codes").alias("pass", "code"))
    order = ("pass", "dims", "code", "node")
    cell = F.shiftright("code", CODE_BITS - bits).alias("cell")
    placed = durable(rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).select("node", "pass", "dims", cell, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy("pass", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.withColumn("shift", before - F.col("least")).select("pass", "part", "shift")
    rank = placed.withColumn("part", part).join(offset, ["pass", "part"]).select("node", "pass", "dims", "cell", (F.col("at") + F.col("shift")).alias("rank"))
    # At most a cell for each window of places.
    large = rank.groupBy("pass", "dims", "cell").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("size")).where(F.col("size") > window + 1)
    spot = F.struct("pass", "rank", F.coalesce("start", F.lit(-1).cast("long")).alias("start"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))
    return placed, rank.join(large, ["pass", "dims", "cell"], "left").groupBy("node").agg(F.sort_array(F.collect_list(spot)).alias("spots"))


def unmet(i: np.ndarray, j: np.ndarray, ranks: np.ndarray, starts: np.ndarray, windows: int, tiles: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that neither the first passes' windows (so many of them) nor tiles compare."""
    for p in range(max(windows, tiles)):
        if not len(i):
            break
        new = np.ones(len(i), bool)
        if p < windows:
            new &= np.abs(ranks[i, p] - ranks[j, p]) > window
        if p < tiles:
            new &= (starts[i, p] != starts[j, p]) | (starts[i, p] < 0)
        i, j = i[new], j[new]
    return i, j


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def results(node: np.ndarray, counts: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Rows (a, b, n): b is null for counts, n for edges to the label."""
    linked = np.flatnonzero(counts)
    joined = np.flatnonzero(label != np.arange(len(node)))
    return pd.DataFrame(
        {
            "a": np.concatenate([node[linked], node[joined]]),
            "b": pd.array([None] * len(linked) + node[label[joined]].tolist(), "Int64"),
            "n": pd.array(counts[linked].tolist() + [None] * len(joined), "Int64"),
        }
    )


def compare(block: pd.DataFrame, number: int, at: int, threshold: float, window: int, size: int) -> pd.DataFrame:
    """Link counts and forest edges of one block."""
    block = block.sort_values("rank", kind="stable")
    rank = block["rank"].to_numpy()
    node = block["node"].to_numpy()
    weight = block["copies"].to_numpy()
    ranks, starts = np.stack(block["ranks"].to_numpy()), np.stack(block["starts"].to_numpy())
    dims = np.array([len(v) for v in block["v"]])
    counts = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    anchors = int(np.searchsorted(rank, (number + 1) * size))
    for d in np.unique(dims):
        of = np.flatnonzero(dims == d)
        x = unit(block["v"].iloc[of])
        near = (x @ x.T >= threshold) & (np.abs(rank[of][:, None] - rank[of][None, :]) <= window)
        near &= ~np.eye(len(of), dtype=bool)
        # Both ends in the overlap: the next block's pair.
        near[np.ix_(of >= anchors, of >= anchors)] = False
        if not near.any():
            continue
        mine = label[of]
        while True:
            low = np.where(near, mine[None, :], len(node)).min(axis=1)
            new = np.minimum(mine, low)
            if (new == mine).all():
                break
            mine = new
        label[of] = mine
        i, j = np.nonzero(np.triu(near))
        i, j = unmet(of[i], of[j], ranks, starts, at, at, window)
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
    return results(node, counts, label)


def compare_tile(tile: pd.DataFrame, at: int, first: int, second: int, threshold: float, window: int) -> pd.DataFrame:
    """Link counts and forest edges between two chunks of one cell, or inside one."""
    tile = tile.sort_values("rank", kind="stable")
    rank, chunk = tile["rank"].to_numpy(), tile["chunk"].to_numpy()
    node, weight = tile["node"].to_numpy(), tile["copies"].to_numpy()
    ranks, starts = np.stack(tile["ranks"].to_numpy()), np.stack(tile["starts"].to_numpy())
    x = unit(tile["v"])
    counts = np.zeros(len(node), np.int64)
    up = np.arange(len(node))
    left, right = np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for k in range(0, len(left), STRIP):
        of = left[k : k + STRIP]
        i, j = np.nonzero((x[of] @ x[right].T >= threshold) & (rank[of][:, None] < rank[right][None, :]))
        i, j = unmet(of[i], right[j], ranks, starts, at + 1, at, window)
        if not len(i):
            continue
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        # Every pair's ends reach a common label by the smallest labels of rows and columns.
        label = np.arange(len(node))
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, low[i])
            if (low == label).all():
                break
            label = low
        for a in np.flatnonzero(label != np.arange(len(node))):
            a, b = root(a), root(label[a])
            up[max(a, b)] = min(a, b)
    return results(node, counts, np.array([root(a) for a in range(len(node))], np.int64))


def near_duplicates(embeddings: DataFrame, *, threshold: float = 0.95, window: int = WINDOW, recall: float = RECALL, seed: int = 5, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = durable(
        embeddings.select(F.col("vec_id").cast("long"), v.alias("v"), F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)).alias("ok"))
        .withColumn("node", F.when(F.col("ok"), F.xxhash64("v", F.lit(seed))))
    )
    # A class, one of its vectors, and how many rows it has.
    vectors = durable(rows.where("ok").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).select("node", "v", "copies"))
    n = vectors.count()
    passes = passes or passes_for(n, threshold, window, recall)
    spread = max(1, min(n * passes // 4096 + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed, spots = ranked(codes(vectors, passes, seed), spread, cell_bits(n, window), window)
    spots = spots.select("node", F.col("spots.rank").alias("ranks"), F.col("spots.start").alias("starts"), F.explode("spots").alias("spot")).select("node", "ranks", "starts", "spot.*")
    spots = durable(vectors.join(spots, "node"))
    forget(placed)
    rank, number = F.col("rank"), F.floor(F.col("rank") / BLOCK)
    # A block's first ranks also stand in the block before it.
    both = F.when((rank % BLOCK < window) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    blocks = spots.withColumn("block", F.explode(both))

    def each(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return compare(block, int(key[1]), int(key[0]), threshold, window, BLOCK)

    # A chunk of a large cell stands in its tile with each chunk of the cell.
    chunk = F.floor((rank - F.col("start")) / TILE)
    tiles = spots.where("start >= 0").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / TILE))))
    tiles = tiles.withColumns({"first": F.least("chunk", "other"), "second": F.greatest("chunk", "other")})

    def tiled(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        return compare_tile(tile, int(key[0]), int(key[2]), int(key[3]), threshold, window)

    schema = "a long, b long, n long"
    in_tiles = tiles.drop("other", "size").groupBy("pass", "start", "first", "second").applyInPandas(tiled, schema)
    found = durable(blocks.drop("start", "size").groupBy("pass", "block").applyInPandas(each, schema).unionByName(in_tiles))
    label = components(found.where("b is not null").select("a", "b"))
    # From classes to rows: the smallest vec_id of a component's classes; vec_ids in several classes join those.
    member = rows.where("ok").select("node", "vec_id").distinct().join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = member.groupBy("component").agg(F.min("vec_id").alias("to"))
    ids = components(member.join(smallest, "component").select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    links = durable(vectors.select("node", "copies").join(links, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    forget(found, spots, label, vectors)
    out = rows.select("vec_id", "node").join(links, "node", "left").join(ids.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
