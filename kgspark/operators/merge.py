"""Merges of graph increments into DataFrames: every function returns the new state, nothing is changed in place.

Keys: nodes by (canvas_id, id), edges by (canvas_id, src, rel, dst).  The row with the least ``ord`` of a batch counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import KEY, degree, first_per_key, ids

NODE = ["canvas_id", "id"]


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is new, the first of each."""
    return old.unionByName(first_per_key(new, keys, "ord").join(old.select(*keys), keys, "left_anti").select(*old.columns))


@dataclass
class Delta:
    """What a merge brought: new nodes, new edges, and old nodes that got an edge."""

    nodes: DataFrame
    edges: DataFrame
    touched: DataFrame


def merge_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> Delta:
    """Adds what is absent; edges without both ends are left out."""
    added = first_per_key(new_nodes, NODE, "ord").join(nodes.select(*NODE), NODE, "left_anti")
    known = nodes.select(*NODE).unionByName(added.select(*NODE))
    fresh = first_per_key(new_edges, KEY, "ord").join(edges.select(*KEY), KEY, "left_anti")
    for end in ("src", "dst"):
        fresh = fresh.join(ids(known, end), ["canvas_id", end], "left_semi")
    ends = fresh.select("canvas_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Delta(added.select(*nodes.columns), fresh.select(*edges.columns), ends.join(added.select(*NODE), NODE, "left_anti"))


def unseen_relations(edges: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Relation types in use that are not defined, with empty constraints."""
    empty = F.array().cast("array<string>")
    used = edges.select("canvas_id", F.col("rel").alias("rel_id")).distinct()
    return used.join(relation_types, ["canvas_id", "rel_id"], "left_anti").withColumns({"src_types": empty, "dst_types": empty})


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``gone`` (canvas_id, id) and their edges."""
    left = edges.join(ids(gone, "src"), ["canvas_id", "src"], "left_anti").join(ids(gone, "dst"), ["canvas_id", "dst"], "left_anti")
    return nodes.join(gone.select(*NODE), NODE, "left_anti").select(*nodes.columns), left.select(*edges.columns)


def merge_nodes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, note: str) -> tuple[DataFrame, DataFrame]:
    """Merges ``id`` into ``into`` for all rows of ``pairs`` (canvas_id, id, into; no chains: see components).

    Edges move to the survivor, self-loops and repeats go, and the survivor keeps the lost labels as a property.
    """
    for end in ("src", "dst"):
        moved = pairs.select("canvas_id", F.col("id").alias(end), F.col("into").alias("_new"))
        edges = edges.join(moved, ["canvas_id", end], "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    edges = first_per_key(edges.where("src <> dst"), KEY, "ord")
    lost = nodes.join(pairs, NODE).groupBy("canvas_id", F.col("into").alias("id"))
    kept_labels = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: F.struct(F.lit(note).alias("k"), x["label"].alias("v")))
    lost = lost.agg(kept_labels.alias("_lost"))
    left = nodes.join(pairs.select(*NODE), NODE, "left_anti").join(lost, NODE, "left")
    left = left.withColumn("props", F.when(F.col("_lost").isNotNull(), F.concat("props", "_lost")).otherwise(F.col("props")))
    return left.select(*nodes.columns), edges


def delete_documents(nodes: DataFrame, edges: DataFrame, docs: DataFrame, rel: str = "EVIDENCED_BY") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without documents (canvas_id, id) and the objects that nothing else stands behind; and how each object fared.

    The third frame has ``canvas_id, id, fate`` (``gone`` or ``kept``) for all objects that a deleted document had stood behind.
    """
    links = edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias("id"), F.col("dst").alias("doc")).distinct()
    deleted = docs.select("canvas_id", F.col("id").alias("doc"), F.lit(1).alias("_hit"))
    counted = links.join(deleted, ["canvas_id", "doc"], "left").groupBy(*NODE).agg(F.count("*").alias("_all"), F.count("_hit").alias("_hits"))
    fate = counted.where("_hits > 0").select(*NODE, F.when(F.col("_all") == F.col("_hits"), "gone").otherwise("kept").alias("fate"))
    gone = fate.where("fate = 'gone'").select(*NODE).unionByName(docs.select(*NODE)).distinct()
    left, kept = delete_nodes(nodes, edges, gone)
    return left, kept, fate


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys that ``new`` has are replaced by those of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Latest row of each key; in ``keep_if_null`` columns a null does not replace a value."""
    latest = first_per_key(new, keys, F.desc("ord"))
    joined = old.alias("o").join(latest.alias("n"), keys, "full_outer")
    fresh = F.col("n.ord").isNotNull()

    def pick(name: str) -> Column:
        one = F.when(fresh, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        return (F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}")) if name in keep_if_null else one).alias(name)

    return joined.select(*(F.col(c) if c in keys else pick(c) for c in old.columns))


def replace_documents(nodes: DataFrame, edges: DataFrame, asked: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (canvas_id, id, file, new_file) replaced by what was extracted anew: ``new_nodes`` and ``new_edges`` with ``doc``, the id it is of.

    A file of another name and an extraction without objects are refused, and such a document stays as it is; of the others
    the old objects and edges go first, then the new ones are merged.  The third frame has ``canvas_id, id, objects, verdict``.
    """
    count = new_nodes.where("type <> 'doc'").groupBy("canvas_id", F.col("doc").alias("id")).agg(F.count("*").alias("objects"))
    told = asked.join(count, NODE, "left").withColumn("objects", F.coalesce("objects", F.lit(0)).cast("long"))
    told = told.withColumn("verdict", F.when(F.col("new_file") != F.col("file"), "renamed file").when(F.col("objects") == 0, "empty extraction").otherwise("replaced"))
    done = told.where("verdict = 'replaced'").select(*NODE)
    left, kept, _ = delete_documents(nodes, edges, done)
    own = lambda df: df.join(ids(done, "doc"), ["canvas_id", "doc"], "left_semi")
    delta = merge_delta(left, kept, own(new_nodes).select(*nodes.columns), own(new_edges).select(*edges.columns))
    return left.unionByName(delta.nodes), kept.unionByName(delta.edges), told.select(*NODE, "objects", "verdict")


def guarded_uploads(uploads: DataFrame, sources: DataFrame, object_types: DataFrame, most: int = 10 * 1024 * 1024, kinds: str = r"(?i)[.](xlsx|pptx|docx|dxf|pdf)$") -> tuple[DataFrame, DataFrame]:
    """Uploads (canvas_id, file, size, ord) that may go in, and the others with the ``reason``.

    Refused are files into a canvas without object types, of another kind, empty or larger than ``most`` bytes, and names that
    the sources or an earlier upload have.
    """
    typed = object_types.select("canvas_id").distinct().withColumn("_typed", F.lit(True))
    known = sources.select("canvas_id", "file").distinct().withColumn("_known", F.lit(True))
    rows = uploads.join(typed, "canvas_id", "left").join(known, ["canvas_id", "file"], "left")
    order = Window.partitionBy("canvas_id", "file").orderBy("ord")
    reason = (
        F.when(F.col("_typed").isNull(), "no object types")
        .when(~F.col("file").rlike(kinds), "kind of file")
        .when(F.coalesce("size", F.lit(0)) == 0, "empty file")
        .when(F.col("size") > most, "too large")
        .when(F.col("_known"), "duplicate name")
    )
    rows = rows.withColumn("reason", reason)
    open_ = rows.where("reason is null").withColumn("reason", F.when(F.row_number().over(order) > 1, "duplicate name"))
    shown = lambda df: df.select(*uploads.columns, "reason")
    return open_.where("reason is null").select(*uploads.columns), shown(rows.where("reason is not null")).unionByName(shown(open_.where("reason is not null")))


def logged(changes: DataFrame, shown: int = 5) -> DataFrame:
    """Entries for the change log: ``canvas_id, op, at, ids, summary`` from changes (canvas_id, op, at, id), one for each operation and time.

    ``ids`` counts the objects; the summary names the first ``shown`` of them, which a grouping by rank keeps small.
    """
    key = ["canvas_id", "op", "at"]
    rows = changes.distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", "id")))), lambda x: x["id"]), ", ")
    entries = rows.groupBy(*key).agg(F.count("*").alias("ids"), first.alias("names"))
    more = F.when(F.col("ids") > shown, F.concat(F.lit(" and "), (F.col("ids") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return entries.select(*key, "ids", F.concat(F.col("op"), F.lit(": "), F.col("names"), more).alias("summary"))


def append_log(changes: DataFrame, path: str) -> None:
    """Appends the entries of a batch of changes to a log folder."""
    logged(changes).write.mode("append").parquet(path)


def _merged_maps(rows: DataFrame, keys: list[str], maps: Column) -> DataFrame:
    """``keys, props``: entries of the maps of each key, of equal entry keys the last by ``ord``."""
    each = rows.select(*keys, "ord", F.explode(maps)).groupBy(*keys, "key").agg(F.max_by("value", "ord").alias("value"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def upsert_entities(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Entities (id, name, type, props map, embedding) after the rows of ``new`` (with ``ord``) came in one by one.

    Name and type are those of the last row; properties are merged, the last value of a key counts; the last embedding of
    the right size stays.  Entities without changes are not touched.
    """
    fits = F.size("embedding") == dimension
    rows = old.withColumn("ord", F.lit(None).cast("long")).join(new.select("id").distinct(), "id", "left_semi").select(*old.columns, "ord").unionByName(new.select(*old.columns, "ord"))
    rows = rows.withColumn("ord", F.coalesce("ord", F.lit(-(2**62))))
    last = rows.groupBy("id").agg(F.max_by("name", "ord").alias("name"), F.max_by("type", "ord").alias("type"), F.max_by(F.when(fits, F.col("embedding")), F.when(fits, F.col("ord"))).alias("embedding"))
    props = _merged_maps(rows, ["id"], F.col("props"))
    none = F.create_map().cast("map<string,string>")
    changed = last.join(props, "id", "left").withColumn("props", F.coalesce("props", none)).select(*old.columns)
    return old.join(new.select("id").distinct(), "id", "left_anti").select(*old.columns).unionByName(changed)


def upsert_relations(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (src, type, dst, weight, props map) after the rows of ``new`` (with ``ord``); rows without both entities are left out.

    The last weight that is given counts, properties are merged.
    """
    keys = ["src", "type", "dst"]
    for end in ("src", "dst"):
        new = new.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    fresh = new.select(*keys).distinct()
    rows = old.join(fresh, keys, "left_semi").select(*old.columns).withColumn("ord", F.lit(-(2**62))).unionByName(new.select(*old.columns, "ord"))
    last = rows.groupBy(*keys).agg(F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("ord"))).alias("weight"))
    none = F.create_map().cast("map<string,string>")
    changed = last.join(_merged_maps(rows, keys, F.col("props")), keys, "left").withColumn("props", F.coalesce("props", none)).select(*old.columns)
    return old.join(fresh, keys, "left_anti").select(*old.columns).unionByName(changed)


def survivors(nodes: DataFrame, edges: DataFrame, group: Column) -> DataFrame:
    """``canvas_id, id, into``: each node but the winner of its group, and the winner (most edges, shortest, least id)."""
    rows = nodes.withColumn("_group", group).join(degree(edges), NODE, "left")
    key = ["canvas_id", "type", "_group"]
    rank = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.length("id").alias("l"), F.col("id").alias("i"))
    best = rows.groupBy(*key).agg(F.min_by("id", rank).alias("into"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    return rows.alias("r").join(best.alias("b"), same).where("id <> into").select("r.canvas_id", "id", "into")
