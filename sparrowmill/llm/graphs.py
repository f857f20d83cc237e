"""Connected components in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Edges up to this many (16 bytes each) are joined up on the driver; every step on more of them takes seven shuffles, however few they are.
FEW = 500_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their roots: each edge hooks the greater root to the lesser, and paths are halved until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, root: the smallest node of its component, for every node of `edges` (a, b: long).

    Up to `few` edges go to the driver.  Beyond, alternating large-star and small-star steps: each keeps components as they are and never
    makes more edges than there were, and paths shrink geometrically.  Every step is written to
    the shared folder, and deleted when the next one is.  No edges, no rows; a graph that
    hasn't settled after `rounds` steps is an error, not an unfinished result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen = stash(pairs), None
    if pairs.count() <= few:
        t = pairs.toArrow()
        discard(pairs)
        node, root = _roots(*(t.column(c).to_numpy() for c in ("u", "v")))
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())}))
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        before, pairs = pairs, stash(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(before)
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
