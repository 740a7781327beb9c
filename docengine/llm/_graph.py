"""Connected components by contraction, and spanning forests of what a task has found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast


def forest(a, b, distance):
    """Positions of the links (ids ``a``, ``b``: arrays) of a spanning forest of least total distance: nearest links first."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    kept = []
    for d in np.unique(distance):
        at = np.flatnonzero(distance == d)
        while len(at):
            while (root[root] != root).any():
                root = root[root]
            at = at[root[x[at]] != root[y[at]]]
            if not len(at):
                break
            # Each root is hung below one smaller root at most, so no circle can close.
            rx, ry = root[x[at]], root[y[at]]
            high, low = np.maximum(rx, ry), np.minimum(rx, ry)
            _, first = np.unique(high, return_index=True)
            root[high[first]] = low[first]
            kept.append(at[first])
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b: long): labels are equal in a component and distinct between them.

    ``node`` is the node's ``xxhash64``, a permutation of 64-bit integers, and labels are such values too: in this shuffled
    order a node's smallest neighbour is a random one. Each round moves every node to the smallest of its neighbours and itself; links follow
    their ends, loops and repeats go. What were neighbours stay neighbours or become one, so components are kept, and both
    nodes and links shrink by a constant factor, so the rounds grow with the logarithm of the largest component.
    """
    links = edges.select(F.xxhash64(F.col("a").cast("long")).alias("a"), F.xxhash64(F.col("b").cast("long")).alias("b")).where("a <> b")
    links = scratch.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links0")
    steps = []
    while not steps or not links.isEmpty():
        k = len(steps)
        both = links.union(links.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
        steps.append(scratch.table(step, f"step{k}"))
        told = checked_broadcast(steps[-1], 32)
        moved = links.join(told.toDF("x", "u"), F.col("a") == F.col("x")).join(told.toDF("y", "v"), F.col("b") == F.col("y")).where("u <> v")
        links = scratch.table(moved.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), f"links{k + 1}")
        scratch.drop(f"links{k}")
    labels = steps[-1]
    for k in reversed(range(len(steps) - 1)):
        above = checked_broadcast(labels, 32).toDF("x", "u")
        labels = steps[k].join(above, F.col("label") == F.col("x"), "left").select("node", F.coalesce("u", "label").alias("label"))
        labels = scratch.table(labels, f"labels{k}")
    return labels
