"""Facts that contradict each other, over all projects: what users say against the record, and markets against similar designs.

Rows ``canvas_id, kind, id, other, detail, evidence, trace, confidence``; none without evidence and a trace of real edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import clamp01, half_up, hop

from .graph import both_ways, evidence, first_per_key
from .infer import node_text

# Words of hot and humid markets, the least confidence of a finding, and how many of a rule are told.
HUMID = ("아시아", "동남아", "중국", "중동", "고온다습")
LEAST, TOP = 40, 5

NODE = ["canvas_id", "id"]


def mentions(nodes: DataFrame, prefix: str = "소비자언급.") -> DataFrame:
    """``canvas_id, id, label, symptom, detail, ord, i``: what users say about projects, from properties with this prefix."""
    rows = nodes.where("type = 'proj'").select(*NODE, "label", "ord", F.posexplode("props").alias("i", "p")).where(F.col("p.k").startswith(prefix))
    return rows.select(*NODE, "label", F.substring("p.k", len(prefix) + 1, 10_000).alias("symptom"), F.col("p.v").alias("detail"), "ord", "i")


def struck(nodes: DataFrame, edges: DataFrame, wanted: Column) -> DataFrame:
    """``canvas_id, id, fm, name``: of each project the first failure mode on record (OCCURRED_IN) whose ``label`` meets the condition."""
    fms = nodes.where("type = 'fm'").where(wanted).select("canvas_id", F.col("id").alias("fm"), F.col("label").alias("name"))
    rows = edges.where("rel = 'OCCURRED_IN'").select("canvas_id", F.col("src").alias("id"), F.col("dst").alias("fm"), "ord")
    return first_per_key(rows.join(fms, ["canvas_id", "fm"]), NODE, "ord").drop("ord")


def proofs(nodes: DataFrame, edges: DataFrame, shown: int = 2) -> DataFrame:
    """``canvas_id, id, docs, files, first``: number of documents of a node, the names of the first ones, and the first one's id."""
    rows = evidence(nodes, edges).withColumn("n", F.row_number().over(Window.partitionBy(*NODE).orderBy("ord", "doc")))
    some = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "filename")))), lambda x: x["filename"])
    return rows.groupBy(*NODE).agg(F.count("*").alias("docs"), some.alias("files"), F.min_by("doc", "n").alias("first"))


def _told(rows: DataFrame, order: list[Column | str], top: int | None, least: int) -> DataFrame:
    rows = rows.where(F.col("confidence") >= least)
    if top is not None:
        place = F.row_number().over(Window.partitionBy("canvas_id").orderBy(F.desc("confidence"), *order))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= top)
    return rows.select("canvas_id", "kind", "id", "other", "detail", "evidence", "trace", "confidence")


def record_gaps(nodes: DataFrame, edges: DataFrame, wanted: Column, top: int | None = TOP, least: int = LEAST, prefix: str = "소비자언급.") -> DataFrame:
    """Projects with documents that users speak about while no such failure is on record."""
    said = mentions(nodes, prefix).join(struck(nodes, edges, wanted).select(*NODE), NODE, "left_anti").join(proofs(nodes, edges), NODE)
    number = F.coalesce(F.regexp_extract("detail", "([0-9]+)", 1).try_cast("int"), F.lit(1))
    share = 0.5 + clamp01(number / 8) * 0.3 + clamp01(F.col("docs") / 5) * 0.2
    rows = said.withColumns(
        {
            "kind": F.lit("record-gap"),
            "other": F.col("symptom"),
            "evidence": F.concat(F.array(F.concat(F.lit(prefix), "symptom")), "files"),
            "trace": F.array(hop(F.col("id"), F.lit("EVIDENCED_BY"), F.col("first"))),
            "confidence": half_up(clamp01(share) * 100),
        }
    )
    return _told(rows, ["ord", "i"], top, least)


def market_gaps(nodes: DataFrame, edges: DataFrame, wanted: Column, words: tuple[str, ...] = HUMID, top: int | None = TOP, least: int = LEAST) -> DataFrame:
    """Projects for humid markets without such a failure that are SIMILAR, either way, to a project that had it."""
    had = struck(nodes, edges, wanted)
    humid = node_text(nodes.where("type = 'proj'")).where(F.col("text").rlike("|".join(words))).select(*NODE, "ord").join(had.select(*NODE), NODE, "left_anti")
    near = both_ways(edges.where("rel = 'SIMILAR'")).withColumn("w", clamp01(F.coalesce("weight", F.lit(0.5)))).withColumnRenamed("ord", "link")
    other = had.select("canvas_id", F.col("id").alias("other"), "fm", "name")
    docs = proofs(nodes, edges).select("canvas_id", F.col("id").alias("fm"), "docs", "files")
    rows = humid.join(near, NODE).join(other, ["canvas_id", "other"]).join(docs, ["canvas_id", "fm"], "left")
    share = 0.55 * F.col("w") + 0.25 * clamp01(F.coalesce("docs", F.lit(0)) / 10) + 0.2
    link = F.when(F.col("dir") == "out", hop(F.col("id"), F.lit("SIMILAR"), F.col("other"))).otherwise(hop(F.col("other"), F.lit("SIMILAR"), F.col("id")))
    rows = rows.withColumns(
        {
            "kind": F.lit("market-env"),
            "detail": F.col("name"),
            "evidence": F.concat(F.array("name"), F.coalesce("files", F.array().cast("array<string>"))),
            "trace": F.array(link, hop(F.col("other"), F.lit("OCCURRED_IN"), F.col("fm"))),
            "confidence": half_up(clamp01(share) * 100),
        }
    )
    return _told(rows, ["ord", F.desc("dir"), "link"], top, least)


def contradictions(nodes: DataFrame, edges: DataFrame, wanted: Column, words: tuple[str, ...] = HUMID, top: int | None = TOP) -> DataFrame:
    """Both rules, each with its most certain findings."""
    return record_gaps(nodes, edges, wanted, top).unionByName(market_gaps(nodes, edges, wanted, words, top))
