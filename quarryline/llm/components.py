"""Connected components by alternating large and small stars; nothing is collected, no neighbour list is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's least neighbour (itself included) takes over its larger (large star) or its smaller neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for each node of the links (u, v); nodes without a link are not in it."""
    edges = written(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components", links.count())
    before, most = None, edges.count()
    for _ in range(MOST_ROUNDS):
        edges = written(_star(_star(edges, True), False), "components", most)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
