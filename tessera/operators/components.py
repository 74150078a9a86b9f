"""Connected components of an edge table: forests of its parts, then alternating large and small stars.

The edges are dealt evenly to parts of at most PART edges, and each part gives the forest of its edges, stars around
their least nodes.  One part is the answer.  More go on after Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014): each round is two joins on the edge table and is written to the shared folder, so lineage and lost
executors cost one round.  Only a count and a checksum come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import discard, materialise

PART = 1 << 19


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for every node of the edges that is not the least of its component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _part_forest(batches):
    """The forest of a part; edges are held until there are PART of them, then their forest is."""
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size > 2 * PART:
            held = [forest(*(np.concatenate(side) for side in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > PART:
                yield pa.record_batch({"u": pa.array(held[0][0]), "v": pa.array(held[0][1])})
                held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    u, v = forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
    yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang larger neighbours on the least one.  Small star: hang smaller neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", part: int = PART) -> DataFrame:
    """(node, component) for every node of an edge, component being its least reachable node.

    Nodes are longs.  Null ends and loops are no edges; repeated and reversed edges count once.  No edges: no rows.
    """
    given = materialise(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")), "edges")
    parts = max(1, math.ceil(given.count() / part))
    current = materialise(given.repartition(parts).mapInArrow(_part_forest, "u long, v long").distinct(), "edges")
    discard(given)
    if parts > 1:
        mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        state = mark(current)
        while state[0]:
            after = materialise(_stars(_stars(current, True), False), "edges")
            new = mark(after)
            discard(current)
            current, state, old = after, new, state
            if state == old:
                break
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
