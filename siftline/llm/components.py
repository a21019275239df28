"""Connected components over a table of edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrays, durable, give_back

#: Edges (16 bytes each) of a graph that one task finishes; larger ones are contracted by distributed rounds, to the end
#: if need be.
FINISH = 1_000_000


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node that are above it (large) or below it (small) go to its least one.

    The least neighbour is joined back, so that a node with very many edges can be split over tasks.
    """
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = sides.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2) if len(ends) else (ends, ends)
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[a], up[b])
        apart = up[a] != up[b]
        if not apart.any():
            return nodes, nodes[up]
        a, b, low = a[apart], b[apart], low[apart]
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while not (up[up] == up).all():
            up = up[up]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(nodes), 100_000):
            yield arrays(node=nodes[at : at + 100_000], component=least[at : at + 100_000])
    give_back()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Rows of (node, component) for the nodes of ``edges`` (columns a and b, long): the component's least node.

    Every step is a checkpointed table; nothing but counts and a checksum comes to the driver.  Star steps go on until
    nothing changes or ``FINISH`` edges are left at most, which one task joins.  No edges, no rows.
    """
    sign = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = now.agg(*sign).first()
    for _ in range(most):
        if was["n"] <= FINISH:
            return durable(now.coalesce(1).mapInArrow(_finish, "node long, component long"))
        now = durable(_starred(_starred(now, True), False))
        mark = now.agg(*sign).first()
        if mark == was:
            break
        was = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
