"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, save


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v) that is not itself the smallest of its component.

    Each round hangs neighbours below the smallest node they know; rounds grow with the logarithm
    of the longest path. Every step is a written table, so a lost executor repeats one step and the
    minima have no partitioning of their own: adaptive execution can split the join at a hub.
    """
    e = save(spark, edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = save(spark, both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).select(F.col("x").alias("v"), "m"), "large-star")
        large = save(spark, e.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "large-links")
        least = save(spark, large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        old, e = e, save(spark, small.distinct(), "links")
        forget(spark, old, low, large, least)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, links given as two index arrays."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
