"""Connected components of a large graph, given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallflow.session import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in a link; component is the least node reachable.

    Least labels flow along links, then each label is replaced by that of the node it
    names, so chains halve. Every step is written out: a lost executor costs a re-read, and
    joins of written tables can split a hub. Labels only fall, so an equal sum ends it.
    """
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    ways = F.explode(F.array(F.struct(x, y), F.struct(F.col(b).alias("x"), F.col(a).alias("y"))))
    both = cut(links.where(F.col(a) != F.col(b)).select(ways.alias("e")).select("e.x", "e.y").distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component"))
    labels = cut(labels)
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = None
    while (now := labels.agg(total).first()[0]) != before:
        before = now
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").select(F.col("x").alias("node"), "component")
        low = cut(labels.unionByName(near).groupBy("node").agg(F.min("component").alias("component")))
        hop = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(low.join(hop, "component").select("node", F.col("further").alias("component")))
    return labels


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least reachable index of each of ``n`` nodes under the links (i, j)."""
    root = np.arange(n)
    while True:
        was = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(was, root):
            return root
