"""Connected components by alternating star contraction; edges stay distributed throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.lineage import cut, discard


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b); the component is its smallest node.

    Each round sends every node's larger neighbours to its smallest (large star), then its
    smaller ones (small star); groups are pre-aggregated minima, never collected.  Rounds
    grow with the logarithm of the longest path; edges with a null or equal ends are ignored.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), bare=True)
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), bare=True)
        discard(old)
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 with edges (i, j): the smallest node of each one's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (new := root[root]).tobytes() != root.tobytes():
            root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root
