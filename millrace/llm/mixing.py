"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. Its documents, shuffled by a keyed hash and repeated
up to ``max_epochs`` times (an epoch is shuffled anew), get a virtual finish
time: the source's words so far divided by its target. All queues are then
merged by that time and cut where the total budget is spent.

Defined results: null or empty texts have size 0 and take 0; a null source is
a source of its own, after all others; rows that repeat are mixed as rows of
their own; an empty table gives an empty result; columns besides doc_id, text
and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed_prefix, durable, forget, free_name

#: Rows of a source that one window sorts, on average.
ROWS_PER_BUCKET = 192


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null: 0."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\x01")
    return F.length(F.regexp_replace(gaps, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Per source: source_size, target. sizes: (source, source_size), a row a source.

    target = min(cap, level * weight) with one level for all: shares above
    a cap (max_epochs times the size) go to the other sources by weight. The level
    comes from the sources in the order of cap / weight, with running sums.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    full = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # The level if this source is the first that stays below its cap; the true one is the first that fits its own source.
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    w = w.withColumn("place", F.row_number().over(full))
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"]
    return w.withColumn("target", F.least("cap", F.coalesce(fits * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target", "budget")


def mix(documents: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_epochs: int = 3, seed: int = 17, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, weight, taken, epochs and row for every row of documents.

    row: a column of documents that numbers its rows; without it they are numbered as they are first stored.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    base = durable(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", F.xxhash64("text"), F.lit(seed)).alias("key"), number.alias("row")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, max_epochs))
    known = targets.withColumnRenamed("source", "of")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    n = base.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    # One row for each document and epoch; epochs run one after the other in a source's queue.
    copies = (
        rows.where("size > 0 and target > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_epochs - 1), F.floor(F.col("target") / F.col("source_size")).cast("int")))))
        .withColumn("u", F.xxhash64("key", "row", "epoch"))
        .withColumn("bucket", F.col("epoch") * buckets + F.pmod("u", F.lit(buckets)))
    )
    queued = bucketed_prefix(copies.select("row", "source", "size", "target", "epoch", "bucket", "u"), ["source"], "bucket", [F.col("u"), F.col("row")], "size", "cum", buckets * max_epochs)
    # Virtual finish time at the middle of the document, so that a queue ends as near to its target as below it.
    timed = durable(queued.withColumn("finish", (F.col("cum") - F.col("size") / 2) / F.col("target")).where("finish <= 2").select("row", "epoch", "size", "finish"))
    merged = bucketed_prefix(timed.withColumn("slot", F.floor(F.col("finish") * buckets)), [], "slot", [F.col("finish"), F.col("row"), F.col("epoch")], "size", "spent", buckets * 2)
    budget = targets.agg(F.max("budget").alias("total"))
    sent = merged.crossJoin(F.broadcast(budget)).where(F.col("spent") - F.col("size") / 2 <= F.col("total"))  # one row: the budget
    taken = durable(sent.groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("epochs")))
    forget(timed)
    return rows.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", "weight", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("epochs", F.lit(0)).cast("int").alias("epochs"), "row"
    )


def mix_rows(documents: DataFrame, **options) -> DataFrame:
    """documents as the mix takes them: each row as often as it is taken, with all its columns.

    The rows are stored with a number each first, so it does not matter where they come from.
    """
    row, epochs, copy = (free_name(documents, name) for name in ("row", "epochs", "copy"))
    kept = durable(documents.withColumn(row, F.monotonically_increasing_id()))
    times = mix(kept, row=row, **options).where("epochs > 0").select(F.col("row").alias(row), F.col("epochs").alias(epochs))
    out = kept.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"`{epochs}`"))))
    return out.drop(row, epochs, copy)
