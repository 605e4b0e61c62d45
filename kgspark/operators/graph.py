"""Joins and walks over nodes and edges.  Every join includes ``canvas_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

KEY = ["canvas_id", "src", "rel", "dst"]


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the place from 1 of each row of a key in the given order, the rows of one key dealt to many tasks.

    Rows are sorted into ranges, which are numbered apart and shifted by the rows of the key in the ranges before them.
    """
    ranges = settle(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_range")]
    rows = ranges.withColumn("_i", F.row_number().over(within)).alias("r").join(counts.alias("c"), same)
    return rows.select(*(f"r.{c}" for c in df.columns), (F.col("_start") + F.col("_i")).cast("int").alias(name))


def ids(nodes: DataFrame, name: str) -> DataFrame:
    """``canvas_id`` and the node ids under another name."""
    return nodes.select("canvas_id", F.col("id").alias(name))


def intact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, the first of each key, whose two ends exist."""
    edges = first_per_key(edges, KEY, "ord")
    return edges.join(ids(nodes, "src"), ["canvas_id", "src"], "left_semi").join(ids(nodes, "dst"), ["canvas_id", "dst"], "left_semi").select(*edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    """``canvas_id, id, degree``: in and out, a self-loop twice."""
    ends = edges.select("canvas_id", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("canvas_id", "id").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``degree``, 0 for those without edges."""
    return nodes.join(degree(edges), ["canvas_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def follow(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, rels: Sequence[str]) -> DataFrame:
    """``canvas_id, anchor, rel, id, label``: targets of the anchors (canvas_id, anchor) over some relations."""
    step = anchors.join(edges.where(F.col("rel").isin(*rels)).withColumnRenamed("src", "anchor"), ["canvas_id", "anchor"])
    return step.withColumnRenamed("dst", "id").join(nodes.select("canvas_id", "id", "label"), ["canvas_id", "id"]).select("canvas_id", "anchor", "rel", "id", "label")


def both_ways(edges: DataFrame) -> DataFrame:
    """``canvas_id, id, rel, other, dir, weight, ord``: every edge seen from both ends, ``out`` and ``in``."""
    out = edges.select("canvas_id", F.col("src").alias("id"), "rel", F.col("dst").alias("other"), F.lit("out").alias("dir"), "weight", "ord")
    back = edges.select("canvas_id", F.col("dst").alias("id"), "rel", F.col("src").alias("other"), F.lit("in").alias("dir"), "weight", "ord")
    return out.unionByName(back)


def neighbours(edges: DataFrame, rels: Sequence[str] | None = None, direction: str = "both") -> DataFrame:
    """Distinct ``canvas_id, id, rel, other, dir``; a neighbour reached both ways counts as ``out``."""
    seen = both_ways(edges if rels is None else edges.where(F.col("rel").isin(*rels)))
    seen = seen if direction == "both" else seen.where(F.col("dir") == direction)
    return first_per_key(seen, ["canvas_id", "id", "rel", "other"], F.desc("dir"), "ord").select("canvas_id", "id", "rel", "other", "dir")


def evidence(nodes: DataFrame, edges: DataFrame, rel: str = "EVIDENCED_BY") -> DataFrame:
    """``canvas_id, id, doc, filename, ord``: documents that stand behind a node."""
    docs = nodes.where("type = 'doc'").select("canvas_id", F.col("id").alias("doc"), F.col("label").alias("filename"))
    links = edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias("id"), F.col("dst").alias("doc"), "ord")
    return links.join(docs, ["canvas_id", "doc"]).select("canvas_id", "id", "doc", "filename", "ord")


def k_hop(seeds: DataFrame, edges: DataFrame, depth: int, settle=lambda df: df) -> DataFrame:
    """``canvas_id, seed, id, hops``: nodes within ``depth`` undirected steps of each seed, at their least distance.

    Each step joins only the newest frontier; ``settle`` may cut the lineage between steps.
    """
    links = settle(both_ways(edges).select("canvas_id", "id", "other").where("id <> other").distinct())
    frontier = seeds.select("canvas_id", F.col("id").alias("seed"), "id").distinct().withColumn("hops", F.lit(0))
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.select("canvas_id", "seed", "id").join(links, ["canvas_id", "id"]).select("canvas_id", "seed", F.col("other").alias("id")).distinct()
        frontier = settle(step.join(seen.select("canvas_id", "seed", "id"), ["canvas_id", "seed", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def shortest_ways(seeds: DataFrame, edges: DataFrame, depth: int, settle=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Nodes ``canvas_id, seed, id, hops, path`` within ``depth`` undirected steps, and the edges ``canvas_id, seed, src, rel, dst, hops`` of all shortest ways to them.

    Each level joins only the newest nodes and keeps every edge that leads to a new one.  Of several shortest ways a node's ``path`` is the first
    by the ids along it; an edge's ``hops`` is the distance of its farther end.
    """
    links = settle(both_ways(edges).where("id <> other").select("canvas_id", "id", "other", "rel", "dir").distinct())
    key = ["canvas_id", "seed", "id"]
    frontier = seeds.select("canvas_id", F.col("id").alias("seed"), "id").distinct().select(*key, F.lit(0).alias("hops"), F.array("id").alias("path"))
    seen, ways = frontier, None
    for hop in range(1, depth + 1):
        step = frontier.select("canvas_id", "seed", F.col("id").alias("last"), "path").join(links.withColumnRenamed("id", "last"), ["canvas_id", "last"]).withColumnRenamed("other", "id")
        new = settle(step.join(seen.select(*key), key, "left_anti"))
        out = F.col("dir") == "out"
        way = new.select("canvas_id", "seed", F.when(out, F.col("last")).otherwise(F.col("id")).alias("src"), "rel", F.when(out, F.col("id")).otherwise(F.col("last")).alias("dst"), F.lit(hop).alias("hops"))
        ways = way if ways is None else ways.unionByName(way)
        frontier = settle(new.groupBy(*key).agg(F.min("path").alias("path")).select(*key, F.lit(hop).alias("hops"), F.concat("path", F.array("id")).alias("path")))
        seen = seen.unionByName(frontier)
    return seen, ways if ways is not None else links.limit(0).selectExpr("canvas_id", "id as seed", "id as src", "rel", "other as dst", "0 as hops")


def hop_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are within reach of a seed: ``canvas_id, seed, src, rel, dst``."""
    one = reached.select("canvas_id", "seed", F.col("id").alias("src"))
    other = reached.select("canvas_id", "seed", F.col("id").alias("dst"))
    return one.join(edges.select(*KEY), ["canvas_id", "src"]).join(other, ["canvas_id", "seed", "dst"]).select("canvas_id", "seed", "src", "rel", "dst")


def transitive(edges: DataFrame, rel: str = "CONSISTS_OF", confidence: float = 0.85) -> DataFrame:
    """Pairs two or three steps of a relation apart that have no edge of it: ``canvas_id, src, dst, via, confidence``.

    Of several ways the shortest counts, then the least ``via``; no way visits a node twice.
    """
    step = edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    nxt = lambda one, two: step.select("canvas_id", F.col("a").alias(one), F.col("b").alias(two))
    two = step.join(nxt("b", "c"), ["canvas_id", "b"]).where("a <> c")
    three = two.join(nxt("c", "d"), ["canvas_id", "c"]).where("d <> a and d <> b")
    ways = two.select("canvas_id", F.col("a").alias("src"), F.col("c").alias("dst"), F.array("b").alias("via")).unionByName(
        three.select("canvas_id", F.col("a").alias("src"), F.col("d").alias("dst"), F.array("b", "c").alias("via"))
    )
    best = ways.groupBy("canvas_id", "src", "dst").agg(F.min(F.struct(F.size("via").alias("n"), F.col("via"))).alias("best"))
    known = step.select("canvas_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return best.join(known, ["canvas_id", "src", "dst"], "left_anti").select("canvas_id", "src", "dst", F.col("best.via").alias("via"), F.lit(confidence).alias("confidence"))


def symmetric(edges: DataFrame, rel: str = "SIMILAR", weight: float = 0.7) -> DataFrame:
    """Missing reverse edges of a relation: ``canvas_id, src, dst, confidence`` (the edge's weight, or a default)."""
    own = edges.where((F.col("rel") == rel) & (F.col("src") != F.col("dst")))
    back = own.select("canvas_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce("weight", F.lit(weight)).alias("confidence"), "ord")
    back = first_per_key(back, ["canvas_id", "src", "dst"], "ord").drop("ord")
    return back.join(own.select("canvas_id", "src", "dst"), ["canvas_id", "src", "dst"], "left_anti")


def chained(edges: DataFrame, first: str = "CONSISTS_OF", second: str = "HAS_FAILURE", confidence: float = 0.7, limit: int | None = None) -> DataFrame:
    """Pairs over two relations without a direct edge of the second: ``canvas_id, src, dst, via, confidence``."""
    one = edges.where(F.col("rel") == first).select("canvas_id", "src", F.col("dst").alias("via"))
    two = edges.where(F.col("rel") == second).select("canvas_id", F.col("src").alias("via"), "dst")
    pairs = one.join(two, ["canvas_id", "via"]).groupBy("canvas_id", "src", "dst").agg(F.min("via").alias("via"))
    known = edges.where(F.col("rel") == second).select("canvas_id", "src", "dst")
    out = pairs.join(known, ["canvas_id", "src", "dst"], "left_anti").withColumn("confidence", F.lit(confidence))
    return out if limit is None else out.orderBy("canvas_id", "src", "dst").limit(limit)


def degree_key(nodes: DataFrame, edges: DataFrame) -> Column:
    """Order by which one of several equal nodes survives: most edges, shortest id, least id."""
    return F.struct((-F.col("degree")).alias("d"), F.length("id").alias("l"), F.col("id").alias("i"))


def documents_as_nodes(nodes: DataFrame, edges: DataFrame, rel: str = "EVIDENCED_BY") -> tuple[DataFrame, DataFrame]:
    """Entities and documents as one node table with ``kind``, evidence turned into MENTIONS from the document."""
    kind = F.when(F.col("type") == "doc", "document").otherwise("entity")
    view = nodes.select("canvas_id", "id", "label", "type", kind.alias("kind"))
    mentions = edges.where(F.col("rel") == rel).select("canvas_id", F.col("dst").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("src").alias("dst"))
    return view, edges.where(F.col("rel") != rel).select(*KEY).unionByName(mentions)
