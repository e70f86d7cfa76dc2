"""Connected components by alternating large and small stars over edge tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelpay.llm.common import Store, splittable


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of a node and its neighbours; made so that joins on u can be split."""
    return splittable(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("least")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    links = joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return links.unionByName(joined.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself: the edges are stars then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) but the smallest of its component, that smallest one."""
    now = store.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _settled(now):
        now = store.put(_small_star(_large_star(now)), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
