"""Connected components by local forests, then alternating stars; linear tables, no group is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of which a task makes a forest at once.
LOCAL_EDGES = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some edges that are not the smallest of their component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        u, v = (np.concatenate([common.column(b, c).to_numpy() for b in held]) for c in "uv")
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= 2 * LOCAL_EDGES:
            yield done()
    if held:
        yield done()


def connected(edges: DataFrame, rounds: int = 40, local: int = LOCAL_EDGES, files: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not its own root; root is the smallest node reachable.

    Edges are dealt out to tasks, `local` to each, which keep a forest of theirs; what several tasks hold is joined by stars.
    Tables in between are kept as `files` files at most.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = common.cut(e, files), None
    parts = -(-e.count() // local)
    e = e.repartition(max(1, parts)).mapInArrow(_forests, "u long, v long")
    if parts <= 1:  # one task held every edge
        return common.cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")))
    e = common.cut(e.distinct(), files)
    for _ in range(rounds):
        # v is u's smaller neighbour; the smallest neighbour of v replaces it. A node without a smaller one keeps its edges.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        low = common.cut(low.select(F.col("u").alias("v"), "m"), files)  # a table of its own, so that the join below can split a hot v
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), files)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
