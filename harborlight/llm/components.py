"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that edges (a, b) join to a smaller one; component: the smallest that it reaches.

    Large-star and small-star rounds: each round points nodes nearer to their smallest neighbour, so paths shorten
    geometrically and no group is ever gathered. Edges of a node with itself or with nulls are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    current = checkpointed(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    for _ in range(most_rounds):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*")
            .where("hi <> lo")
            .distinct()
        )
        current = checkpointed(small)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected_components did not settle")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches over the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
