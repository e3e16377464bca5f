"""Connected components of a link table by alternating stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import discard, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per node the lowest of itself and its neighbours. Written, so that the join with it can split hot nodes."""
    return settle(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "lowest")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (columns a, b); the component is its smallest node.

    Each round hangs neighbours on the lowest neighbour (large star), then the lower ones among themselves (small
    star), until nothing changes. Rounds grow with the logarithm of the longest path. Sums per node are combined before
    they are shuffled. No links give an empty table.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                   .distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = settle(both.where("v > u").join(_lowest(both), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = _lowest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        before, edges = edges, settle(
            small.unionAll(low.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), "links")
        discard(before, large, low)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
