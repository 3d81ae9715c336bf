"""Connected components of links between numbers, as Spark joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.store import written


def _hooked(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node (larger ones, or smaller ones and itself) hang on the smallest."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of the links ``a``, ``b``.

    Links may come in any direction and more than once; links of a node to itself are ignored, so such a node is
    only there if it has another link. Every round is written to the shared folder. The number of rounds grows
    with the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        now = written(_hooked(_hooked(now, True), False), "links")
        then, state = state, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == then or not state[0]:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def local_stars(i, j, n):
    """Component labels of n points linked by the index pairs (i, j): each point's smallest reachable index."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, m)
        np.minimum.at(after, j, m)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label
