"""Connected components of a link table, by alternating large and small stars; nothing reaches the driver but whether it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the smallest node that links lead to.

    Null ends and loops link nothing; repeated links count once; an empty table gives an empty result. A large star hangs a
    node's larger neighbours on the smallest node it knows, a small star does so with the node itself and its smaller
    neighbours. Neither changes the components, and both shorten chains by halves, so the rounds grow with the logarithm of
    a component's size. They go on until the links are stars, each node hanging on one that hangs on nothing; no number of
    rounds is set. The smallest neighbour is a minimum, which combines before it moves, and a hub's links are one side of a
    join, which Spark splits. Every step is stored.
    """
    real = links.where("a is not null and b is not null and a <> b")
    edges = stored(real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stored(_hung(both, both.where("b > a"), False))
        edges = stored(_hung(edges, edges, True))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _hung(known: DataFrame, moved: DataFrame, itself: bool) -> DataFrame:
    """moved(a, b), with each b on the smallest node that a knows, and a on it too if itself is set."""
    least = known.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    made = moved.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (made.unionByName(least.select("a", F.col("m").alias("b"))) if itself else made).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").limit(1).count() == 0
