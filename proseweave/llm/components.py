"""Connected components: a forest of one batch of links in numpy, and star contraction of a link table in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each id that keeps the same components: id and the smallest id of its component here."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while len(x):
        px, py = parent[x], parent[y]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            higher = parent[parent]
            if (higher == parent).all():
                break
            parent = higher
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (id, component_id): the smallest id reachable, for every id with a link.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the longest chain.
    A popular id is met by a minimum with map-side combine and by a join that Spark can split, never by a list."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = cut_lineage(edges), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (seen.n, seen.h) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        state = (seen.n, seen.h)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u > v").distinct())
