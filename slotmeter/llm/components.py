"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each step connects nodes to their smallest known neighbour; edges never outnumber the input's, and
a logarithmic number of rounds suffices in practice. No node's neighbours are gathered in one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotmeter.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    if large:  # every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    else:  # u and its smaller neighbours go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; component is the smallest id reachable.

    Loops, repeats and both directions are allowed; edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    sign = None
    for _ in range(max_rounds):
        edges = cut(_stars(_stars(edges, large=True), large=False))
        # stars are stable once every edge points at a node that points nowhere
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def spanning_forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (x, y) between nodes 0..n-1 connect what the edges before them did not."""
    parent, kept = list(range(n)), []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)
