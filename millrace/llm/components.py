"""Connected components of a distributed edge table.

Each round hooks every node to its smallest neighbour, shortens the chains by
pointer jumping and contracts the edges, so the table shrinks until at most
`at_once` edges are left (a bound on one task's memory, whatever the input);
one task ends those. Hubs are met by partial aggregation and by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget

JUMPS = 3
#: So many contracted edges at most (16 bytes each) are ended by one task.
AT_ONCE = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and the smallest node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        x, y = label[one], label[other]
        apart = x != y
        if not apart.any():
            return node, node[label]
        one, other, x, y = one[apart], other[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def ended(edges: DataFrame) -> DataFrame:
    """(node, component) of at most AT_ONCE edges (a, b), by one task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            node, component = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(each, "node long, component long")


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node reachable.

    An edge from a node to itself names a node without others. The result is a
    stored table, and nothing else of what was written stays.
    """
    left = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = None
    while left.count() > at_once:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = durable(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
        parent = first
        for _ in range(JUMPS):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        parent = durable(parent)
        forget(first)
        of = lambda end: parent.select(F.col("node").alias(end), F.col("p").alias(f"p{end}"))  # noqa: E731, B023
        shrunk = durable(
            left.join(of("a"), "a").join(of("b"), "b").where("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        )
        label = moved(label, parent.select("node", F.col("p").alias("component")))
        forget(parent, left)
        left = shrunk
    label = moved(label, ended(left))
    forget(left)
    return label


def moved(label: DataFrame | None, to: DataFrame) -> DataFrame:
    """The stored table label with its components replaced as `to` (node, component) says."""
    if label is None:
        return durable(to)
    out = durable(label.join(to.select(F.col("node").alias("component"), F.col("component").alias("p")), "component", "left").select("node", F.coalesce("p", "component").alias("component")))
    forget(label)
    return out
