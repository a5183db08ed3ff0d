"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become token ids plus a final id 0; longer ones are cut so that only
the first piece is short. Pieces are dealt by a hash into packs of bounded
size. Several islands evolve every pack, each in tasks of its own: a
population of packings, whose crossover injects whole well-filled bins of one
parent into the other, removes the duplicates this makes, and best-fits the
documents that lost their bin. Between epochs each island's elite moves on to
the next island of the ring. The pack's best packing wins.

Defined results: null text counts as empty (one token, id 0); rows that repeat
are packed as rows of their own; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

END_OF_TEXT = "<|endoftext|>"
#: Pieces in a pack; also bounds what a task holds.
PACK_PIECES = 2048
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6


# ------------------------------------------------------------------ tokens
class Ids:
    """Token ids of texts by a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    The same vocabulary's rank file, where there is one beside it, gives the
    same ids several times faster; texts that hold a special token's string go
    through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path and os.path.exists(ranks_path):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.core = self.fast._core_bpe

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or END_OF_TEXT in text:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), np.uint32)


_IDS: dict[tuple, Ids] = {}


def ids_of(path: str, ranks_path: str | None) -> Ids:
    if (path, ranks_path) not in _IDS:
        _IDS[path, ranks_path] = Ids(path, ranks_path)
    return _IDS[path, ranks_path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as few as can be, the first takes what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, capacity: int, tokenizer: str, ranks: str | None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ids_of(tokenizer, ranks)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                out += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    slim = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInPandas(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------ genetics
def best_fit(bins: list[list[int]], free: list[int], items: list[int], length: np.ndarray, capacity: int) -> None:
    """Put every item into the bin with the least room that holds it; bins and their free room change in place."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in items:
        n = int(length[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            f, b = room.pop(at)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        free[b] = f - n
        if f > n:
            insort(room, (f - n, b))


def to_bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    edges = np.flatnonzero(np.diff(assigned[order])) + 1
    return [b.tolist() for b in np.split(order, edges)] if len(order) else []


def to_assigned(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def fitness(assigned: np.ndarray, length: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean of squared fill)."""
    fill = np.bincount(assigned, weights=length) / capacity
    return -len(fill), float((fill**2).mean())


def crossover(one: np.ndarray, other: np.ndarray, length: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of `other` into `one`: bins that share a document with them go, and
    those bins' other documents are placed by best fit, the longest first."""
    fill = np.bincount(other, weights=length)
    full = fill >= np.quantile(fill, 0.5)
    chosen = full & (random.random(len(fill)) < 0.5)
    injected = chosen[other]
    struck = np.zeros(int(one.max()) + 1, bool)
    struck[one[injected]] = True
    kept = ~struck[one]
    displaced = np.flatnonzero(~injected & ~kept)
    child = np.where(injected, other, np.where(kept, one + len(fill), -1))
    _, child_packed = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = child_packed
    free = (capacity - np.bincount(child_packed, weights=length[child >= 0])).astype(int).tolist()
    extra: list[list[int]] = [[] for _ in free]
    best_fit(extra, free, displaced[np.argsort(-length[displaced], kind="stable")].tolist(), length, capacity)
    for b, items in enumerate(extra):
        if items:
            child[items] = b
    return child


def mutate(assigned: np.ndarray, length: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """Empty the worst-filled bins and a few more, and best-fit their documents."""
    fill = np.bincount(assigned, weights=length)
    gone = (fill <= np.quantile(fill, 0.03)) | (random.random(len(fill)) < 0.03)
    keep = ~gone[assigned]
    child = np.full(len(assigned), -1)
    _, child[keep] = np.unique(assigned[keep], return_inverse=True)
    free = (capacity - np.bincount(child[keep], weights=length[keep])).astype(int).tolist() if keep.any() else []
    extra: list[list[int]] = [[] for _ in free]
    items = np.flatnonzero(~keep)
    best_fit(extra, free, items[np.argsort(-length[items], kind="stable")].tolist(), length, capacity)
    for b, put in enumerate(extra):
        if put:
            child[put] = b
    return child


def evolve(length: np.ndarray, elite: list[np.ndarray], seed: int, capacity: int, population: int, generations: int) -> np.ndarray:
    """The best packing after some generations. length is sorted, longest first; elite: packings to start from."""
    random = np.random.default_rng(seed)
    n = len(length)
    # No packing can use fewer bins than this; one that gets there is not improved on.
    least = -(-int(length.sum()) // capacity)
    people = list(elite)
    while len(people) < population:
        # Best fit decreasing; later ones with the order shaken.
        order = np.arange(n) if not people else np.argsort(-length * random.uniform(0.9, 1.1, n), kind="stable")
        bins: list[list[int]] = []
        best_fit(bins, [], order.tolist(), length, capacity)
        people.append(to_assigned(bins, n))
        if -fitness(people[-1], length, capacity)[0] <= least:
            return people[-1]
    scored = sorted(((fitness(p, length, capacity), p) for p in people), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break
        a, b = random.choice(len(scored), 2, replace=False)
        child = crossover(scored[min(a, b)][1], scored[max(a, b)][1], length, capacity, random)
        if random.random() < 0.5:
            child = mutate(child, length, capacity, random)
        scored = sorted([*scored, (fitness(child, length, capacity), child)], key=lambda x: x[0], reverse=True)[:population]
    return scored[0][1]


def islands(state: DataFrame, epoch: int, capacity: int, population: int, generations: int, seed: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pack, island, length, elite in zip(batch["pack"], batch["island"], batch["lengths"], batch["elite"], strict=True):
                length = np.asarray(length, np.int64)
                start = [np.asarray(e, np.int64) for e in elite]
                best = evolve(length, start, hash((int(pack), int(island), epoch, seed)) & 0x7FFFFFFF, capacity, population, generations)
                bins, full = fitness(best, length, capacity)
                out.append((pack, island, best.astype(np.int32), bins, full))
            yield pd.DataFrame(out, columns=["pack", "island", "best", "bins", "full"])

    return state.mapInPandas(each, "pack long, island int, best array<int>, bins int, full double")


def pack(documents: DataFrame, *, tokenizer: str, ranks: str | None = None, capacity: int = 2048, seed: int = 3) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cuts = durable(pieces(documents, capacity, tokenizer, ranks).withColumn("row", F.monotonically_increasing_id()))
    n = cuts.where(F.col("length") < capacity).count()
    packs = max(1, -(-n // PACK_PIECES))
    part = cuts.where(F.col("length") < capacity).withColumn("pack", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(packs)).cast("long"))
    # The longest first; a pack is bounded, whatever the documents are.
    member = F.struct((-F.col("length")).alias("minus"), F.col("row"))
    table = durable(
        part.groupBy("pack").agg(F.sort_array(F.collect_list(member)).alias("m"))
        .select("pack", F.transform("m", lambda m: (-m["minus"]).cast("int")).alias("lengths"), F.transform("m", lambda m: m["row"]).alias("rows"))
    )
    ring = table.select("pack", "lengths", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    none = F.array().cast("array<array<int>>")
    tasks = max(1, min(packs * ISLANDS, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = ring.withColumn("elite", none).repartition(tasks, "pack", "island")
    best = durable(islands(state, 0, capacity, POPULATION, GENERATIONS, seed))
    for epoch in range(1, EPOCHS):
        # An island goes on with its own elite and that of the island before it in the ring.
        moved = best.select("pack", "best", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).alias("island"))
        elite = moved.groupBy("pack", "island").agg(F.sort_array(F.collect_set("best")).alias("elite"))
        best = durable(islands(ring.join(elite, ["pack", "island"]).repartition(tasks, "pack", "island"), epoch, capacity, POPULATION, GENERATIONS, seed))
    winner = best.groupBy("pack").agg(F.max_by("best", F.struct("bins", "full", (-F.col("island")).alias("i"))).alias("best"))
    placed = (
        table.join(winner, "pack")
        .select("pack", F.explode(F.arrays_zip("best", "lengths", "rows")).alias("p"))
        .groupBy("pack", F.col("p.best").alias("bin"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("p.lengths")).alias("minus"), F.col("p.rows").alias("row")))).alias("m"))
        .select("pack", "bin", F.posexplode("m").alias("i", "x"), "m")
        .select(
            F.col("x.row").alias("row"),
            (F.col("pack") * (PACK_PIECES * 64) + F.col("bin")).cast("long").alias("sequence_id"),
            F.aggregate(F.slice("m", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, m: s - m["minus"]).alias("offset"),
        )
    )
    # A piece of full length is a sequence of its own; negative ids keep the two kinds apart.
    whole = cuts.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")})
    rest = cuts.where(F.col("length") < capacity).join(placed, "row")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(columns).unionByName(rest.select(columns))
