"""Connected components of a written edge table, by alternating stars.

Each step links every node to the smallest neighbour it knows, first seen from
the smaller side, then from the larger, so paths halve and the edges end as one
star per component. Before it is written, what a step has in one task is joined
by union and find there, so a partition passes on at most one edge per node and
most paths end early. Every step is a few shuffles of the edges; nothing is kept
on the driver but two numbers that tell whether anything changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


#: Edges joined at once inside a task.
HELD = 500_000


def _forest(a, b):
    """Edges (node, smallest node of its tree) of the forest that the edges make."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        # nodes are sorted, so the smaller place is the smaller node
        parent[max(x, y)] = min(x, y)
    root = np.arange(len(nodes))
    for x in range(len(nodes)):
        root[x] = root[parent[x]]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _join_batches(batches):
    """A task's edges as stars; what exceeds ``HELD`` edges is joined piece by piece."""
    a, b = [], []

    def joined():
        found = _forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    for batch in batches:
        a.append(np.asarray(batch.column(0)))
        b.append(np.asarray(batch.column(1)))
        if sum(map(len, a)) >= HELD:
            yield joined()
            a, b = [], []
    if a:
        yield joined()


def _joined(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_join_batches, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node.

    ``edges`` needs a <> b; repeated edges and both directions are allowed.
    """
    now = scratch.write(_joined(edges), f"{name}-0")
    step, seen = 0, None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen, step = sign, step + 1
        now = scratch.write(_joined(_small_star(_large_star(now))), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
