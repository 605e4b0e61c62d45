"""Consistency of parts lists, for all items at once: materials with a failure history, and closed items without a vent.

Unlike expansions are found by ``infer.expansion_gaps``.  Every finding names edges that exist and stands in ``item, rule, level, part, fm, cause,
confidence, trace, evidence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import hop

from .graph import evidence, first_per_key

# Confidence with and without a known cause, and of a closed item without a vent.
WITH_CAUSE, WITHOUT_CAUSE, CLOSED = 78, 65, 80


def first_documents(nodes: DataFrame, edges: DataFrame, name: str, shown: int = 2) -> DataFrame:
    """``canvas_id, <name>, <name>_docs``: file names of the first documents behind a node."""
    place = F.row_number().over(Window.partitionBy("canvas_id", "id").orderBy("ord"))
    rows = evidence(nodes, edges).withColumn("n", place).where(F.col("n") <= shown)
    files = F.transform(F.array_sort(F.collect_list(F.struct("n", "filename"))), lambda x: x["filename"])
    return rows.groupBy("canvas_id", F.col("id").alias(name)).agg(files.alias(f"{name}_docs"))


def _listed(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def material_histories(nodes: DataFrame, edges: DataFrame, materials: Column, pattern: str) -> DataFrame:
    """Parts of known material (an array of names out of ``props``) with a failure mode whose label meets the pattern."""
    key = ["canvas_id"]
    items = nodes.where("type = 'item'").select("canvas_id", F.col("id").alias("item"))
    known = nodes.select("canvas_id", F.col("id").alias("part"), F.col("label").alias("part_label"), F.array_distinct(materials).alias("materials")).where(F.size("materials") > 0)
    fms = nodes.where((F.col("type") == "fm") & F.col("label").rlike(pattern)).select("canvas_id", F.col("id").alias("fm"), F.col("label").alias("fm_label"))
    causes = first_per_key(edges.where("rel = 'CAUSED_BY'"), ["canvas_id", "src"], "ord").select("canvas_id", F.col("src").alias("fm"), F.col("dst").alias("cause"))
    causes = causes.join(nodes.select("canvas_id", F.col("id").alias("cause"), F.col("label").alias("cause_label")), ["canvas_id", "cause"])
    struck = edges.where("rel = 'HAS_FAILURE'").select("canvas_id", F.col("src").alias("part"), F.col("dst").alias("fm")).distinct()
    # what a part has failed by is worked out once for each part, whatever number of items it belongs to
    struck = struck.join(known, [*key, "part"]).join(fms, [*key, "fm"]).join(causes, [*key, "fm"], "left")
    struck = struck.join(first_documents(nodes, edges, "part"), [*key, "part"], "left").join(first_documents(nodes, edges, "fm"), [*key, "fm"], "left")
    owners = edges.where("rel = 'CONSISTS_OF'").select("canvas_id", F.col("src").alias("item"), F.col("dst").alias("part")).distinct().join(items, [*key, "item"], "left_semi")
    rows = owners.join(struck, [*key, "part"])
    steps = F.array(hop("item", F.lit("CONSISTS_OF"), "part"), hop("part", F.lit("HAS_FAILURE"), "fm"), F.when(F.col("cause").isNotNull(), hop("fm", F.lit("CAUSED_BY"), "cause")))
    named = F.array(F.concat("part_label", F.lit(": "), F.array_join("materials", " · ")), F.col("fm_label"), F.col("cause_label"))
    proof = F.array_distinct(F.array_compact(F.concat(named, _listed("part_docs"), _listed("fm_docs"))))
    score = F.when(F.col("cause").isNotNull(), WITH_CAUSE).otherwise(WITHOUT_CAUSE)
    return rows.select("item", F.lit("history").alias("rule"), F.lit("warn").alias("level"), "part", "fm", "cause", score.alias("confidence"), F.array_compact(steps).alias("trace"), proof.alias("evidence"))


def text_meets(pattern: str) -> Column:
    """Whether the subtitle or a property value of a node meets the pattern."""
    return F.coalesce(F.col("sub").rlike(pattern), F.lit(False)) | F.exists("props", lambda p: F.coalesce(p["v"].rlike(pattern), F.lit(False)))


def closed_without_vent(nodes: DataFrame, edges: DataFrame, closed: str, vent: str, shown: int = 8) -> DataFrame:
    """Items that are closed by their own text, or else by that of the first node that leads to them, and have parts but no vent among them.

    Of the parts the first ``shown`` stand in trace and evidence; ``n_parts`` counts all.
    """
    key = ["canvas_id", "item"]
    kids = edges.where("rel = 'CONSISTS_OF'").select("canvas_id", F.col("src").alias("item"), F.col("dst").alias("part"), "ord")
    vents = nodes.where(F.col("label").rlike(vent) | text_meets(vent)).select("canvas_id", F.col("id").alias("part"), F.lit(1).alias("vented"))
    names = nodes.select("canvas_id", F.col("id").alias("part"), F.col("label").alias("part_label"))
    kids = kids.join(names, ["canvas_id", "part"]).join(vents, ["canvas_id", "part"], "left")
    parts = kids.groupBy(*key).agg(F.count("*").alias("n_parts"), F.max("vented").alias("vented")).where("vented is null")
    first = kids.join(parts.select(*key), key, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where(F.col("n") <= shown)
    first = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "part", "part_label"))).alias("first"))
    own = nodes.where(F.col("type") == "item").select("canvas_id", F.col("id").alias("item"), F.col("label").alias("item_label"), text_meets(closed).alias("own"))
    sources = nodes.where(text_meets(closed)).select("canvas_id", F.col("id").alias("src"), F.col("label").alias("source_label"))
    into = edges.select("canvas_id", "src", "rel", F.col("dst").alias("item"), "ord").join(sources, ["canvas_id", "src"])
    into = first_per_key(into, key, "ord").select(*key, F.col("src").alias("source"), "rel", "source_label")
    rows = parts.join(own, key).join(into, key, "left").where("own or source is not null").join(first, key)
    way = F.when(~F.col("own"), hop("source", "rel", "item"))
    steps = F.concat(F.array(way), F.transform("first", lambda p: hop(F.col("item"), F.lit("CONSISTS_OF"), p["part"])))
    said = F.concat(F.array(F.when(F.col("own"), F.col("item_label")).otherwise(F.col("source_label"))), F.transform("first", lambda p: p["part_label"]))
    return rows.select(
        "item", F.lit("closed").alias("rule"), F.lit("risk").alias("level"), F.when(~F.col("own"), F.col("source")).alias("source"), "n_parts",
        F.lit(CLOSED).alias("confidence"), F.array_compact(steps).alias("trace"), F.array_distinct(said).alias("evidence"),
    )
