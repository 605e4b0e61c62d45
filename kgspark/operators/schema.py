"""The metamodel: object types, relation types, subtypes and property definitions, each with ``canvas_id``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import first_per_key

KEYS = {
    "object_types": ["canvas_id", "type_id"],
    "relation_types": ["canvas_id", "rel_id"],
    "subtypes": ["canvas_id", "type_id", "st_id"],
    "property_defs": ["canvas_id", "type_id", "key"],
}


@dataclass(frozen=True)
class Metamodel:
    """``object_types`` (type_id, label, description), ``relation_types`` (rel_id, label, src_types, dst_types), ``subtypes`` (type_id, st_id,
    label, keywords) and ``property_defs`` (type_id, key, label, datatype)."""

    object_types: DataFrame
    relation_types: DataFrame
    subtypes: DataFrame
    property_defs: DataFrame


def load_metamodel(spark: SparkSession, path: str, canvas: str | None = None) -> Metamodel:
    """The four tables under a folder, of one canvas or of all; tables partitioned by canvas are read for that one only."""
    rows = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in KEYS}
    return Metamodel(**{name: df if canvas is None else df.where(F.col("canvas_id") == canvas) for name, df in rows.items()})


def save_metamodel(model: Metamodel, path: str) -> None:
    """Writes the four tables, partitioned by canvas."""
    for name in KEYS:
        getattr(model, name).write.partitionBy("canvas_id").parquet(f"{path.rstrip('/')}/{name}")


def upsert_types(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Definitions of one of the four tables with those of ``new`` (the same columns and ``ord``) in their place; the last one of a key counts."""
    keys = KEYS[name]
    latest = first_per_key(new, keys, F.desc("ord")).select(*old.columns)
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest)


def delete_types(model: Metamodel, asked: DataFrame, nodes: DataFrame) -> tuple[Metamodel, DataFrame]:
    """Takes object types (canvas_id, type_id) out where no node has them, with their subtypes and property definitions.

    The second frame tells of each one asked for how many nodes still use it; those above 0 stay.
    """
    keys = ["canvas_id", "type_id"]
    used = nodes.groupBy("canvas_id", F.col("type").alias("type_id")).agg(F.count("*").alias("uses"))
    told = asked.select(*keys).distinct().join(model.object_types.select(*keys), keys, "left_semi").join(used, keys, "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))
    gone = told.where("uses = 0").select(*keys)
    without = lambda df: df.join(gone, keys, "left_anti").select(*df.columns)
    left = replace(model, object_types=without(model.object_types), subtypes=without(model.subtypes), property_defs=without(model.property_defs))
    return left, told


def delete_relation_types(model: Metamodel, asked: DataFrame, edges: DataFrame) -> tuple[Metamodel, DataFrame]:
    """The same for relation types (canvas_id, rel_id) that no edge has."""
    keys = ["canvas_id", "rel_id"]
    used = edges.groupBy("canvas_id", F.col("rel").alias("rel_id")).agg(F.count("*").alias("uses"))
    told = asked.select(*keys).distinct().join(model.relation_types.select(*keys), keys, "left_semi").join(used, keys, "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))
    left = model.relation_types.join(told.where("uses = 0").select(*keys), keys, "left_anti").select(*model.relation_types.columns)
    return replace(model, relation_types=left), told


def taxonomy(nodes: DataFrame, subtypes: DataFrame, order: list[str], unclassified: str = "미분류") -> DataFrame:
    """The tree of types, subtypes and objects as rows ``canvas_id, kind, type, st, id, label, n, type_place, st_place``.

    Types stand in the given order, subtypes (canvas_id, type, st, ord) in that of their definition, those without members left out; objects
    of no defined subtype come last in their type as ``unclassified``.  A type without definitions has its objects right below it.  Objects are
    sorted by label where they are shown; no order runs through all rows.
    """
    place = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(order)))
    rows = nodes.where(F.col("type").isin(order)).select("canvas_id", "id", "type", "label", "st", place.alias("type_place"))
    defined = subtypes.groupBy("canvas_id", "type").agg(F.lit(True).alias("_defined"))
    own = subtypes.groupBy("canvas_id", "type", "st").agg(F.min("ord").cast("long").alias("st_place"))
    rows = rows.join(F.broadcast(own), ["canvas_id", "type", "st"], "left").join(F.broadcast(defined), ["canvas_id", "type"], "left")
    last = F.lit(2**31 - 1).cast("long")
    group = F.when(F.col("st_place").isNotNull(), F.col("st")).when(F.col("_defined"), F.lit(unclassified))
    rows = rows.select("canvas_id", "type", group.alias("st"), "id", "label", "type_place", F.when(F.col("_defined"), F.coalesce("st_place", last)).alias("st_place"))
    level = lambda kind, *keys: rows.groupBy("canvas_id", *keys).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    groups = level("subtype", "type", "st", "type_place", "st_place").where("st is not null")
    every = level("root").unionByName(level("type", "type", "type_place"), allowMissingColumns=True).unionByName(groups, allowMissingColumns=True)
    every = every.unionByName(rows.withColumns({"kind": F.lit("object"), "n": F.lit(1).cast("long")}), allowMissingColumns=True)
    return every.select("canvas_id", "kind", "type", "st", "id", "label", "n", "type_place", "st_place")
