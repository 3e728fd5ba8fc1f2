"""Connected components of links, on one machine (numpy) and over a cluster (alternating stars)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import stored


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, before[side], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def connected(links: DataFrame) -> DataFrame:
    """links: (a, b) of a long type.  Returns (node, label): each linked node and the smallest node of its component.

    Alternates the large-star and small-star steps until the links no longer change; each round is written to the shared
    folder.  Minima are combined before the shuffle; only links travel.
    """
    links = stored(links.where("a != b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = tuple(now)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
