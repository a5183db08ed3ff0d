"""N-gram Jaccard self-join: documents link when the Jaccard similarity of their shingle sets is at least `percent`/100.

Documents with equal sets form a class at once (a set is known by 64-bit
hashes); from there on only classes are compared. Two different sets that link
share SHARED of the first floor(0.2 n) + SHARED shingles of each under any one
global order (at 80 %), so classes that have one of those shingles in common are
candidates. Shingles that very many documents share come last in the
global order (found by sums of what tasks see often; they only move the order,
never the result), so common passages bring few together.

First the classes of each shingle are compared with one leader, the first of one of
LEADERS orders that take turns from shingle to shingle: a row for each class and
shingle, and links found so merge most copies. Shingles whose classes are in
one component by then are done. Those of the others form tiles: of all shingles
with the same smallest class, all classes together, each with its
bitmap signature. A tile is sorted by size and compared in memory in size
bands, one task a tile: bit counts bound each overlap from above, and only
pairs that pass, of different components, leave the task, to be compared exactly as sorted
arrays: in ROUNDS rounds the NEAREST of each class, which merge most of what links,
and in the last round all that are still apart. Tiles of more than MEMBERS classes are dealt out in chunks, a task for
each pair of chunks that are not of one component. So a group of near copies costs in
proportion to its size where its members link, and where they do not, pairs are only
ever looked at in memory; none that could change a component is left out.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; fewer than k words make one shingle; rows that share a
doc_id count as one document; an empty table gives an empty result; columns
besides doc_id and text are ignored. percent is 67 to 100: below, two sets that link may
share one shingle only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, free_name, mix, shingle_sets, signed
from .components import components

#: A shingle of this share of a task's documents (and of 3 at least) counts as common there ...
COMMON_SHARE = 0.0003
#: ... and so many common shingles at most are ordered last (the commonest; the bound on what is broadcast).
COMMON_MOST = 65_536
#: Different sets that link share at least so many shingles: of two sets of a union u, u - 1 at most and 0.67 u at least.
SHARED = 2
LEADERS = 16
#: Classes of a tile that one chunk holds, on average; a task compares two chunks at most.
MEMBERS = 4096
STRIP = 256
#: In the first ROUNDS rounds over the tiles, at most so many pairs of a class leave a strip of a tile.
NEAREST = 4
ROUNDS = 1


# ------------------------------------------------------------------ sets
def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of common shingles, the least common first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        times = np.zeros(0, np.int64)
        n, pending, held = 0, [], 0
        sets_seen: set[int] = set()

        def fold(seen, times, pending, n):
            found, count = np.unique(np.concatenate(pending), return_counts=True)
            floor = max(2, int(COMMON_SHARE * n / 4))
            joined = np.concatenate([seen, found[count >= floor]])
            seen, at = np.unique(joined, return_inverse=True)
            return seen, np.bincount(at, np.concatenate([times, count[count >= floor]])).astype(np.int64)

        for batch in batches:
            for shingles in shingle_sets(batch.column(0), k):
                n += 1
                one = int(set_hash(shingles))
                if one in sets_seen:
                    continue
                sets_seen.add(one)
                pending.append(shingles)
                held += len(shingles)
                if held > 2_000_000:
                    seen, times = fold(seen, times, pending, n)
                    pending, held = [], 0
        if pending:
            seen, times = fold(seen, times, pending, n)
        keep = times >= max(3, COMMON_SHARE * n)
        yield pa.RecordBatch.from_arrays([pa.array(signed(seen[keep])), pa.array(times[keep])], ["shingle", "n"])

    found = docs.select("text").mapInArrow(each, "shingle long, n long")
    top = found.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).collect()
    return np.asarray([r["shingle"] for r in reversed(top)], np.int64).view(np.uint64)


def set_hash(shingles: np.ndarray, salt: int = 0) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.add.reduce(mix(shingles ^ np.uint64(salt)), keepdims=True) + np.uint64(len(shingles)))[0]


def prefix_length(n: int, percent: int) -> int:
    """Among how many first shingles of a set of n are SHARED of those it shares with any linking set."""
    return min(n, n - (-(-percent * n // 100)) + SHARED)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in at least twice as many bits as shingles (a power of two, 64 to 65,536)."""
    bits = min(max(64, 1 << int(2 * len(shingles) - 1).bit_length()), 65_536)
    out = np.zeros(bits, np.uint8)
    out[(mix(shingles) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold_to(map_bytes: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(map_bytes.reshape(-1, size), axis=0)


def overlap_bound(one: bytes, other: bytes, n_one: int, n_other: int) -> int:
    """An upper bound of the overlap: each bit that only one set has stands for a shingle that the other lacks."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(a), len(b))
    a, b = (fold_to(x, size) if len(x) > size else x for x in (a, b))
    return min(n_one - int(np.bitwise_count(a & ~b).sum()), n_other - int(np.bitwise_count(b & ~a).sum()))


def links(inter: int, n_one: int, n_other: int, percent: int) -> bool:
    return 100 * inter >= percent * (n_one + n_other - inter)


def signatures(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n, two hashes of the set, its bitmap, and its first shingles in the global order."""
    broadcast = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_MOST values at most
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.binary()), ("first", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = broadcast.value
        by_hash = np.argsort(last)
        ordered = last[by_hash]
        for batch in batches:
            n, h1, h2, bits, first = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                h1.append(int(set_hash(s)))
                h2.append(int(set_hash(s, 0x5851F42D4C957F2D)))
                bits.append(bitmap(s) if len(s) else None)
                want = prefix_length(len(s), percent) if len(s) else 0
                if len(ordered) and want:
                    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                    is_common = ordered[at] == s
                    if is_common.any():
                        s = np.concatenate([s[~is_common], last[np.sort(by_hash[at[is_common]])]])
                first.append(s[:want].view(np.int64))
            offsets = np.zeros(len(first) + 1, np.int32)
            np.cumsum([len(x) for x in first], out=offsets[1:])
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n long, h1 long, h2 long, bits binary, first array<long>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """node, its sorted shingles as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(each, "node long, shingles binary")


# ------------------------------------------------------------------ pairs
def bitmap_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, na, nb, bits_a, bits_b) whose bitmaps allow a link."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if links(overlap_bound(x[i], y[i], na[i], nb[i]), na[i], nb[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], ["a", "b"])

    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(each, "a long, b long")


def exact_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, one, other: sorted shingles) that link."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
                keep.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "one", "other").mapInArrow(each, "a long, b long")


def with_leaders(tiled: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class and the leader of a shingle (a, b) in whose shingle sizes and the shingle's places still allow a link.

    A shingle at places i and j leaves at most min(i, j) shared ones before it
    and the shorter rest after it. Of the smaller set, whose overlap must be
    2 percent / (100 + percent) of its size, a shorter prefix counts.
    """
    x = tiled.select("shingle", *[F.col(c).alias(f"{c}x") for c in tiled.columns if c != "shingle"])
    y = leaders.select("shingle", *[F.col(c).alias(f"{c}y") for c in leaders.columns if c != "shingle"])
    bound = F.least("ix", "iy") + 1 + F.least(F.col("nx") - F.col("ix") - 1, F.col("ny") - F.col("iy") - 1)
    small_first = F.when(F.col("nx") <= F.col("ny"), F.col("keyx")).otherwise(F.col("keyy"))
    both = x.join(y, "shingle").where("nodex <> nodey").where(small_first & (100 * bound >= percent * (F.col("nx") + F.col("ny") - bound)))
    return both.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


# ------------------------------------------------------------------ tiles
def stacked(maps: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps at `at`, folded to `size` bytes, as rows of 64-bit words."""
    x = np.frombuffer(b"".join(maps[i] for i in at), np.uint8).reshape(len(at), -1)
    return np.bitwise_or.reduce(x.reshape(len(at), -1, size), axis=1).view(np.uint64)


def close_pairs(n: np.ndarray, component: np.ndarray, maps: list[bytes], part: np.ndarray | None, percent: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Indexes of the pairs of different components (and parts, if given) whose bitmaps allow a link, strip by strip.

    Size bands: a class meets those from its own size to 100 / percent times as
    many, so bitmaps of one length, and those of the next one folded to it.
    most: only that many pairs of the highest bounds for each class; the flag says that there are others.
    """
    sizes = np.array([len(m) for m in maps])
    for size in np.unique(sizes):
        left = np.flatnonzero(sizes == size)
        left = left[np.argsort(n[left], kind="stable")]
        for length in (size, 2 * size):
            right = np.flatnonzero(sizes == length)
            if not len(right):
                continue
            right = right[np.argsort(n[right], kind="stable")]
            x, y = stacked(maps, left, size), stacked(maps, right, size)
            # How many shingles a map does not show as bits of their own.
            hidden_x = n[left] - np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            hidden_y = n[right] - np.bitwise_count(y).sum(axis=1, dtype=np.int64)
            for first in range(0, len(left), STRIP):
                rows = slice(first, first + STRIP)
                n_left = n[left[rows]]
                low, high = np.searchsorted(n[right], [n_left[0], n_left[-1] * 100 // percent + 1])
                if low >= high:
                    continue
                columns = slice(low, high)
                bound = np.zeros((len(n_left), high - low), np.int64)
                for w in range(x.shape[1]):
                    bound += np.bitwise_count(x[rows, w][:, None] & y[columns, w][None, :])
                bound += np.minimum(hidden_x[rows][:, None], hidden_y[columns][None, :])
                union = n_left[:, None] + n[right[columns]][None, :] - bound
                keep = 100 * bound >= percent * union
                keep &= component[left[rows]][:, None] != component[right[columns]][None, :]
                if part is not None:
                    keep &= part[left[rows]][:, None] != part[right[columns]][None, :]
                over = most is not None and bool((keep.sum(axis=1) > most).any())
                if over:
                    best = np.argpartition(np.where(keep, -bound / union, 1), most, axis=1)[:, :most]
                    chosen = np.zeros_like(keep)
                    np.put_along_axis(chosen, best, True, axis=1)
                    keep &= chosen
                i, j = np.nonzero(keep)
                if len(i):
                    yield left[rows][i], right[columns][j], over


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of equal first `keys` columns (none null) of batches that are sorted by them; holds one batch and one group."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> list:
        return [batch.column(c)[at].as_py() for c in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(keys):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if held and key(held[0], 0) != key(batch, first):
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.concat_batches(held)


def tile_pairs(tile: DataFrame, classes: DataFrame, percent: int, members: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of classes of different components in a tile (a stored table: lead, node, component) whose bitmaps allow a link.

    most: so many for each class and strip of a tile; a row (lead, null) says that its tile has others.
    """
    per = durable(tile.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("n")))
    large = per.groupBy("lead").agg(F.sum("n").alias("all")).where(F.col("all") > members).select("lead")
    # Chunks of large tiles: a component of a chunk's size or more has chunks of its own, the others share some.
    of = per.join(large, "lead").withColumn("of", F.when(F.col("n") >= members, F.col("component")))
    chunks = durable(of.groupBy("lead", "of").agg(F.ceil(F.sum("n") / members).alias("chunks")))
    name = lambda number: F.concat_ws(".", F.coalesce(F.col("of").cast("string"), F.lit("")), number)
    chunk = chunks.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("part", name("number"))
    x, y = (chunk.select("lead", F.col("of").alias(f"of{e}"), F.col("part").alias(f"part{e}")) for e in "xy")
    met = x.join(y, "lead").where("partx < party and not coalesce(ofx = ofy, false) or partx = party and ofx is null").select("lead", "partx", "party")
    met = met.withColumn("part", F.explode(F.array_distinct(F.array("partx", "party"))))
    place = of.select(F.col("lead").alias("lead_"), F.col("component").alias("component_"), "of")
    place = place.join(chunks.select(F.col("lead").alias("lead_"), F.col("of").alias("of_"), "chunks"), ["lead_"]).where(F.col("of").eqNullSafe(F.col("of_"))).drop("of_")
    member = tile.join(place, (F.col("lead") == F.col("lead_")) & (F.col("component") == F.col("component_"))).withColumn("part", name(F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))))
    dealt = member.select("lead", "node", "component", "part").join(met, ["lead", "part"]).select("lead", "partx", "party", "part", "node", "component")
    small = tile.join(large, "lead", "left_anti").select("lead", F.lit("").alias("partx"), F.lit("").alias("party"), F.lit("").alias("part"), "node", "component")
    work = small.unionByName(dealt).join(classes.select("node", "n", "bits"), "node").select("lead", "partx", "party", "part", "node", "component", "n", "bits")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            first, last = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            part = np.asarray([p == first for p in group.column(3).to_pylist()]) if first != last else None
            node, component, n = (group.column(c).to_numpy() for c in (4, 5, 6))
            others = False
            for i, j, over in close_pairs(n, component, group.column(7).to_pylist(), part, percent, most):
                others |= over
                a, b = node[i], node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            if others:
                yield pa.RecordBatch.from_arrays([group.column(0).slice(0, 1), pa.nulls(1, pa.int64())], ["a", "b"])

    keys = ["lead", "partx", "party"]
    pairs = durable(work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "a long, b long").distinct())
    forget(per, chunks)
    return pairs


def open_tiles(tile: DataFrame, label: DataFrame) -> DataFrame:
    """Those of the tiles (lead, node) whose classes are of several components, with these."""
    now = tile.select("lead", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = now.groupBy("lead").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("lead")
    return durable(now.join(apart, "lead", "left_semi").select("lead", "node", "component"))


def verified(likely: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among the pairs likely (a, b; a stored table, rows without b left out). classes: node and doc_id of one of its documents."""
    pairs = likely.where("b is not null")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.select("node", "doc_id").join(ends, "node", "left_semi")
    arrays = durable(sets(docs.join(wanted, "doc_id"), k).dropDuplicates(["node", "shingles"]))
    one, other = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("one")), arrays.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    found = durable(exact_filter(pairs.join(one, "a").join(other, "b"), percent).distinct())
    forget(likely, arrays)
    return found


def likely_among(candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow a link."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits_{end}"))
    return durable(bitmap_filter(candidates.join(of("a"), "a").join(of("b"), "b"), percent))


def jaccard_components(documents: DataFrame, *, k: int = 5, percent: int = 80, members: int = MEMBERS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents."""
    if not 67 <= percent <= 100:
        raise ValueError("percent is 67 to 100")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    heavy = durable(signatures(docs, k, percent, common_shingles(docs, k)))
    light = durable(heavy.drop("first", "bits"))
    known = "n > 0 and doc_id is not null"
    sized = light.where(known).withColumnRenamed("h1", "node")
    least = sized.groupBy("node", "h2", "n").agg(F.min("doc_id").alias("doc_id"))
    # Shingles among the first that several rows share. Only those go on, a row a class.
    post = heavy.where(known).select(F.col("h1").alias("node"), "n", F.posexplode("first").alias("i", "shingle"))
    often = post.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("shingle")
    kept = durable(post.join(often, "shingle", "left_semi").select("shingle", "node", "n", "i").distinct())
    classes = heavy.where(known).select(F.col("h1").alias("node"), "h2", "n", "bits", "doc_id").join(least, ["node", "h2", "n", "doc_id"], "left_semi")
    classes = durable(classes.join(kept.select("node").distinct(), "node", "left_semi").select("node", "n", "bits", "doc_id").distinct())
    forget(heavy)
    order = F.element_at(F.array(*[F.lit(int(signed([set_hash(np.arange(i, i + 3, dtype=np.uint64))])[0])) for i in range(LEADERS)]), (F.pmod("shingle", F.lit(LEADERS)) + 1).cast("int"))
    tiles = kept.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("node").bitwiseXOR(order)).alias("lead")).where("size > 1")
    tiles = tiles.withColumn("lead", F.col("lead").bitwiseXOR(order))
    # Whether the place is in the smaller set's prefix of a pair.
    key = F.expr(f"i < n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + {SHARED}")
    tiled = durable(kept.join(tiles, "shingle").withColumn("key", key))
    forget(kept)
    led = tiled.select("shingle", "node", "n", "i", "key")
    star = with_leaders(led.join(tiled.where("node = lead").select("shingle", "node"), ["shingle", "node"], "left_anti"), tiled.where("node = lead").select(led.columns), percent)
    found = verified(likely_among(star, classes, percent), docs, classes, k, percent)
    label = components(found)
    # What leaders did not settle: shingles whose classes are not yet in one component.
    rest = tiled.where("size > 2").select("shingle", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rest.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("lead")).where("lo <> hi").select("shingle", "lead")
    tile = durable(rest.join(apart, "shingle").select("lead", "node", "component").distinct())
    forget(tiled)
    for most in (*[NEAREST] * rounds, None):
        pairs = tile_pairs(tile, classes, percent, members, most)
        others = durable(pairs.where("b is null").select(F.col("a").alias("lead")).distinct())
        extra = verified(pairs, docs, classes, k, percent)
        forget(label)
        joined = durable(found.unionByName(extra))
        forget(found, extra)
        found = joined
        label = components(found)
        # Tiles of which all pairs were seen are done; the others go on where their classes are still apart.
        last = tile
        tile = open_tiles(last.join(others, "lead", "left_semi"), label)
        forget(last, others)
        if not tile.limit(1).count():
            break
    forget(tile, classes, found)
    # From classes to documents: the smallest doc_id of a component's classes; doc_ids in several classes join those.
    linked = sized.select("node", "doc_id").distinct().join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("to"))
    ids = components(linked.join(smallest, "component").select(F.col("doc_id").alias("a"), F.col("to").alias("b")))
    forget(label)
    return light.select("doc_id", F.col("n").alias("n_shingles")).join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(documents: DataFrame, **options) -> DataFrame:
    """documents without those whose component has a smaller doc_id (rows that repeat that doc_id stay)."""
    name = free_name(documents, "gone")
    found = jaccard_components(documents, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(found, documents["doc_id"].cast("long") == found[name], "left_anti")
