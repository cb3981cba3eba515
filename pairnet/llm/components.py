"""Connected components of an edge table by alternating star operations.

Large-star links every larger neighbour of a node to the node's smallest
neighbour; small-star links the smaller ones and the node itself to the
smallest. Both keep the components, and the edges turn into stars in
logarithmically many rounds. A round is two aggregates with map-side
combination and two joins; every round is written to the shared folder. The
aggregates are written too: their joins with the edges have two plain shuffles
then, the form in which adaptive execution splits a hub's edges among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairnet.session import checkpoint

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpoint(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every
    node of ``edges(a long, b long)`` that isn't a root itself."""
    now = checkpoint(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        mark = (r["n"], r["h"])
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = checkpoint(_small_star(checkpoint(_large_star(now), "edges")), "edges")
    raise RuntimeError("the components did not settle")
