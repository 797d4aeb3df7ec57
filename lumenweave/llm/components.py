"""Connected components of a table of links, without gathering links anywhere.

Minimum labels travel along links and then jump to the label of their label, so a chain of n links needs about log n
rounds. Every round ends in a checkpoint of the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, root: long): every node of a link and the smallest node that it reaches.

    Null ends are left out; repeated, reversed and self links are allowed; an empty table gives an empty table.
    """
    prepare(links.sparkSession)
    ends = links.select("a", "b").where("a is not null and b is not null")
    both = ends.union(ends.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("far")).where("root != far")
        after = low.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), "was").checkpoint()
        labels = after.select("node", "root")
        if not after.where("root != was").limit(1).count():
            return labels


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 over links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
