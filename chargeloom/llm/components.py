"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release
from .common import checkpointed

#: Rounds double the reach of a label, so this is far beyond any graph that fits on a cluster.
MAX_ROUNDS = 60

#: The edges of one node are joined in so many parts.
HUB_PARTS = 256


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(u, v)`` with ``m``, the smallest ``v`` of their ``u``, and the table ``(u, m)`` alone.

    A component of near copies has a hub, a node that most of its edges start at. Edges are dealt by node and part
    of its neighbours, once for the parts' minima and for the join; only the parts, at most ``HUB_PARTS`` rows a node, meet by node.
    """
    parts = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS))).repartition("u", "part")
    own = parts.groupBy("u", "part").agg(F.min("v").alias("own"))
    own = own.withColumn("m", F.min("own").over(Window.partitionBy("u")))
    return parts.join(own.select("u", "part", "m"), ["u", "part"]).drop("part"), own.filter("own = m").select("u", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood; links may repeat."""
    both, _ = _with_least(edges.union(edges.select("v", "u")).toDF("u", "v"))
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down, least = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node of distinct ``edges(u, v)``, u > v, starts at most one edge, and none if another one ends at it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` that is not itself the root.

    The root of a component is its smallest node. Alternates large-star and small-star rounds (a
    logarithmic number for any shape, also chains) until every edge points at a root. Each round is joins
    and aggregations on narrow rows, the edges of a hub in parts; they are checkpointed in the shared folder, so a lost executor
    costs one round, and what a round shuffled is deleted after it. Edges may repeat, point either way, and join a node to itself; no edges give no rows.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = checkpointed(_small_star(_large_star(edges)))
        release(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
