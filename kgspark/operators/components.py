"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouping by node with a minimum and a join, both over parts of a node's links, so no component is ever
gathered in one place; the lineage is cut after each round.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.lineage import settle


#: Parts that the links of one node are dealt to, so that a node with very many links is no single task's work.
SPREAD = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the least ``b`` of their ``a``."""
    spread = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    parts = spread.groupBy("a", "part").agg(F.min("b").alias("m"))
    parts = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))  # SPREAD rows of a node at most
    return spread.join(parts, ["a", "part"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges stand from the larger node ``a`` to the smaller ``b``."""
    joined = _with_least(edges)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node it is linked to) for every node of ``links`` (a, b), except those least nodes.

    Links with a null end and from a node to itself are left out.
    """
    ordered = links.where("a is not null and b is not null and a <> b")
    edges = settle(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        edges = settle(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
