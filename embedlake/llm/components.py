"""Connected components: large-star, small-star joins, or one task for a small graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.session import cut_lineage


# Edges (16 bytes each) that one task may hold.
SMALL = 1 << 20


def _solve(parts):
    """Components of all edges of one partition, by hooking and pointer jumping."""
    held = [(p.column("a").to_numpy(), p.column("b").to_numpy()) for p in parts if p.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """`node, component` for the nodes of `a, b` edges of longs; component is the smallest node.

    Up to `small` distinct edges are solved in one task of known size; with
    more, or with `small` = 0, the graph stays distributed and every round
    hangs a node's larger neighbours, then its smaller ones, onto its smallest
    neighbour until nothing changes. The number of rounds grows with the
    logarithm of the longest path, one row per edge moves, neighbours are
    reduced by partial aggregates, and AQE splits a hub's join. Edges with a
    null end and loops are ignored; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs, before = cut_lineage(pairs.distinct()), None
    if small and pairs.count() <= small:
        return pairs.coalesce(1).mapInArrow(_solve, "node long, component long")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b"))
        )
        pairs = cut_lineage(small.where("a <> b").distinct())
        now = pairs.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")
        ).first()
        if now == before:
            break
        before = now
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
