"""The life cycle of canvases, as changes of a table (canvas_id, name, description, created, deleted); ``deleted`` is a time or null.

Every change takes many requests at once and returns the new table with a verdict for each request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import slug

from .graph import first_per_key, numbered

COLUMNS = ("canvas_id", "name", "description", "created", "deleted")


def listed(canvases: DataFrame, nodes: DataFrame, sources: DataFrame, trash: bool = False) -> DataFrame:
    """Active canvases, or those in the trash, with how many nodes and sources (canvas_id, file) they have."""
    rows = canvases.where(F.col("deleted").isNotNull() if trash else F.col("deleted").isNull())
    for name, part in (("nodes", nodes), ("sources", sources)):
        rows = rows.join(part.groupBy("canvas_id").agg(F.count("*").alias(name)), "canvas_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return rows


def unique_slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``slug`` to (name, ord): the plain slug if no canvas (canvas_id) and no earlier name has it, else the first free number behind it.

    Names of one slug are numbered in order over many tasks; the numbers that are taken behind a slug stand in one array of it.
    """
    rows = numbered(names.withColumn("base", slug(F.col("name"))), ["base"], ["ord"], "n")
    ending = F.regexp_extract("canvas_id", "^(.*)-([0-9]+)$", 2).try_cast("int")
    numbers = taken.select(F.col("canvas_id").alias("base"), F.lit(1).alias("i")).unionByName(
        taken.where(ending >= 2).select(F.regexp_extract("canvas_id", "^(.*)-([0-9]+)$", 1).alias("base"), ending.alias("i"))
    )
    used = numbers.join(rows.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.array_sort(F.collect_set("i")).alias("used"))
    # the i-th used number leaves used[i] - i free ones before it
    skipped = F.coalesce(F.size(F.filter(F.transform("used", lambda u, i: u - i - 1), lambda free: free < F.col("n"))), F.lit(0))
    rows = rows.join(used, "base", "left").withColumn("_at", F.col("n") + F.when(F.col("used").isNull(), 0).otherwise(skipped))
    name = F.when(F.col("_at") > 1, F.concat_ws("-", "base", F.col("_at").cast("string"))).otherwise(F.col("base"))
    return rows.withColumn("slug", name).select(*names.columns, "slug")


def create(canvases: DataFrame, names: DataFrame) -> DataFrame:
    """Canvases with new ones for ``names`` (name, description, ord); ids are unique among active and deleted ones."""
    new = unique_slugs(names, canvases)
    return canvases.select(*COLUMNS).unionByName(new.select(F.col("slug").alias("canvas_id"), F.trim("name").alias("name"), "description", F.col("ord").alias("created"), F.lit(None).cast("long").alias("deleted")))


def rename(canvases: DataFrame, asked: DataFrame) -> DataFrame:
    """New names and descriptions from ``asked`` (canvas_id, name, description, ord), the last of each canvas."""
    last = first_per_key(asked, ["canvas_id"], F.desc("ord")).select("canvas_id", F.trim("name").alias("_name"), F.col("description").alias("_text"), F.lit(True).alias("_hit"))
    rows = canvases.join(last, "canvas_id", "left")
    return rows.select("canvas_id", F.coalesce("_name", "name").alias("name"), F.when(F.col("_hit"), F.col("_text")).otherwise(F.col("description")).alias("description"), "created", "deleted")


def _verdicts(canvases: DataFrame, asked: DataFrame, verdict: Column) -> DataFrame:
    known = canvases.select("canvas_id", F.col("deleted").isNull().alias("active"))
    return first_per_key(asked, ["canvas_id"], "ord").join(known, "canvas_id", "left").withColumn("verdict", verdict)


def trash(canvases: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks canvases (canvas_id, ord) as deleted at ``ord``; unknown and deleted ones are refused, and the last active one stays."""
    told = _verdicts(canvases, asked, F.when(F.col("active"), "asked").otherwise("unknown"))
    active = canvases.where("deleted is null").agg(F.count("*").alias("active_now"))
    # one row with a count; requests are dealt with in order until one active canvas is left
    valid = numbered(told.where("verdict = 'asked'"), ["verdict"], ["ord", "canvas_id"], "n").join(F.broadcast(active), F.lit(True))
    valid = valid.withColumn("verdict", F.when(F.col("n") < F.col("active_now"), "deleted").otherwise("last one"))
    told = valid.select("canvas_id", "ord", "verdict").unionByName(told.where("verdict <> 'asked'").select("canvas_id", "ord", "verdict"))
    gone = told.where("verdict = 'deleted'").select("canvas_id", F.col("ord").alias("_at"))
    return canvases.join(gone, "canvas_id", "left").withColumn("deleted", F.coalesce("_at", "deleted")).select(*COLUMNS), told


def restore(canvases: DataFrame, asked: DataFrame) -> DataFrame:
    """Takes canvases (canvas_id) out of the trash."""
    back = asked.select("canvas_id").distinct().withColumn("_back", F.lit(True))
    rows = canvases.join(back, "canvas_id", "left")
    return rows.withColumn("deleted", F.when(F.col("_back").isNull(), F.col("deleted"))).select(*COLUMNS)


def purge(canvases: DataFrame, asked: DataFrame, tables: Sequence[DataFrame]) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Takes canvases (canvas_id, ord) and their rows out of all tables for good; only those in the trash."""
    told = _verdicts(canvases, asked, F.when(F.col("active"), "active").when(F.col("active").isNull(), "unknown").otherwise("purged"))
    gone = told.where("verdict = 'purged'").select("canvas_id")
    without = lambda df: df.join(gone, "canvas_id", "left_anti").select(*df.columns)
    return without(canvases), [without(t) for t in tables], told.select("canvas_id", "ord", "verdict")
