"""Connected components of links in tables, by star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, join_skewed, written


def union_pairs(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of nodes a[i] and b[i] in ``labels``, where every node's label ends as the least of its set's."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b; longs) the least node it is linked with.

    Rounds of large-star (hang each larger neighbour on the least one) and small-star
    (hang each node and its lesser neighbours on the least) until nothing changes.
    Minima are taken before the shuffle, and a node with many links is joined by
    broadcast (:func:`join_skewed`), so a hub costs no task more than others. Each
    round's links are a written table; only their number and a hash sum reach the driver.
    Links with a null end join nothing and go; repeated ones count once.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a <> b").select(big, small).distinct(), "links")
    state = _signature(now)
    while state[0]:  # the sum of the links' ends falls with every round that changes one
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        hung = join_skewed(both, least, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(hung.where("u <> v").distinct(), "large")
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        hung = join_skewed(large, least2, "u", "n", state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(hung.where("u <> v").distinct(), "links")
        dropped(now, least, least2, large)
        now, before, state = after, state, _signature(after)
        if state == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
