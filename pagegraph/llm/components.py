"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node and a join, both of which pre-aggregate or split hot
nodes; the edge table is checkpointed in between, and only its count and checksum reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node it knows, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _clean(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _clean(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``, the component being its smallest node; the smallest itself isn't listed."""
    edges = common.checkpoint(_clean(edges))
    seen = None
    for _ in range(most_rounds):
        edges = common.checkpoint(small_star(large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == seen or not now.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
