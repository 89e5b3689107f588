"""Connected components over a distributed list of links, and helpers to make few links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from inkstone.session import cut_lineage


def stars(edges: DataFrame) -> DataFrame:
    """One round: every node and its larger neighbours point to the least node around (large star, then small star).

    The least neighbour comes from an aggregate that is combined before the shuffle, and is joined back,
    so the neighbours of a hub are never gathered in one row.
    """
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"))
    large = (
        both.join(least, "src")
        .filter(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )
    # now every src is larger than its dst
    lowest = large.groupBy("src").agg(F.min("dst").alias("least"))
    near = large.join(lowest, "src")
    small = near.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(near.select("src", F.col("least").alias("dst")))
    return small.filter(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; links have long columns src and dst.

    The component is its smallest node. Rounds go on until the links form stars; their number
    grows with the logarithm of the longest chain, and each ends in a reliable checkpoint.
    Null ends and self links are ignored; no links give an empty table.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = cut_lineage(pairs.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.col("dst").cast("decimal(38,0)")), F.sum(F.col("src").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = cut_lineage(stars(now))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the least place that the links a[i]-b[i] connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new
