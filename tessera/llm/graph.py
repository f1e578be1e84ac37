"""Connected components of edges that never leave the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .textkit import release

#: Share of the edges, as its inverse, from which on a node is a hub.
HUBS = 1000
#: Edges that a task takes on.
EDGES_A_TASK = 200_000
#: Edges that one task joins whole, without rounds: 110 MB and 2 s there as measured, where all their ends differ.
ONE_TASK = 1_000_000


def with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """edges (u, v) with m: least (u, m, degree) of u.

    The nodes of more than `most` edges are at most as many as edges / most, and go to all tasks instead of their edges to
    one; the others meet by key.
    """
    hubs = F.broadcast(least.where(F.col("degree") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, edges["u"] == hubs["hub"], "left")
    near = marked.where("hub is null").select("u", "v").join(least.where(F.col("degree") <= most).select("u", "m"), "u")
    return near.unionByName(marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes of edges u to v in order, the least node that each reaches)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        # each root goes to the least root beside it, then all look through to the roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def joined(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            node, component = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for i in range(0, len(node), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in (node, component)], names=["node", "component"])
        release()

    return edges.select("u", "v").coalesce(1).mapInArrow(join, "node long, component long")


def connected(edges: DataFrame, most: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node reachable; self-loops and repeats are welcome.

    Up to `one_task` different edges meet in one task.  More take rounds: each is several jobs, whose plans, tables sent
    to all tasks and records of tasks the driver holds.

    Alternating large-star and small-star rounds: a node's neighbours move to its
    least neighbour, so stars grow and their number of rounds is logarithmic.  A
    hub's edges are aggregated partially, and its least neighbour goes to where its
    edges are: a node with more than one edge in HUBS of all is a hub, so that there
    are no more than 2 * HUBS of them, and no task gets more edges of one node.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, seen = cut(e), None
    for _ in range(most):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen or not state[0]:
            break
        if state[0] <= one_task:
            return joined(e)
        seen = state
        hub = max(1, 2 * state[0] // HUBS)
        # few edges need few tasks: each shuffle leaves files for each of them
        tasks = 1 + state[0] // EDGES_A_TASK
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = with_least(both, least, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = with_least(large, least, hub).where("v <> m").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
