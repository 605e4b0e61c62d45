"""Links between names that worksheets, decks, reports and model answers state, and the summary of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import auto_id, fold

from .graph import first_per_key
from .ingest import detected_header

Link = tuple[str, str, str]


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _links(rows: DataFrame, links: Sequence[Link], *keep: str) -> DataFrame:
    """Rows (*keep, src, rel, dst) of the links (source column, relation, target column) whose ends are both filled."""
    each = F.array(*(F.struct(F.col(s).alias("src"), F.lit(r).alias("rel"), F.col(t).alias("dst")) for s, r, t in links))
    return rows.select(*keep, F.explode(each).alias("e")).select(*keep, "e.*").where("src is not null and dst is not null")


def worksheet_rows(cells: DataFrame, synonyms: DataFrame, roles: Sequence[str], within: int = 15, core: tuple[str, ...] = ("item", "fm")) -> DataFrame:
    """``file, sheet, r`` and a column per role: rows under the detected header that name a failure mode.

    ``cells`` (file, sheet, r, c, value) have their merged ranges filled; ``synonyms``: role, synonym, ord.  A role is
    read from the column whose header equals a synonym, else holds one; sheets without a header give no rows.
    """
    place = ["file", "sheet"]
    head = detected_header(cells, synonyms, within, core).select(*place, "row", "span")
    words = F.broadcast(synonyms.select("role", "ord", fold(F.col("synonym")).alias("s")))
    under = cells.join(head, place)
    top = under.where("r >= row and r < row + span").withColumn("h", fold(F.col("value"))).join(words, F.col("h").contains(F.col("s")))
    column = first_per_key(top.withColumn("rank", F.when(F.col("h") == F.col("s"), 0).otherwise(1)), [*place, "role"], "rank", "ord", "c").select(*place, "role", "c")
    body = under.where("r >= row + span").join(column, [*place, "c"])
    rows = body.groupBy(*place, "r").agg(*(_filled(F.max(F.when(F.col("role") == x, F.col("value")))).alias(x) for x in roles))
    return rows.where("fm is not null")


def is_cause(text: Column) -> Column:
    """Short noun phrases only: no key with a value, no sentence, no numbered line."""
    return (F.length(text) <= 30) & ~text.rlike("[:：]") & ~text.rlike(r"[.。]\s*$") & ~text.rlike(r"^[0-9]+[.)]?\s")


def deck_links(lines: DataFrame, item: str, fm: str, cause: str, action: str) -> DataFrame:
    """``doc, src, rel, dst`` by name from slides (doc, slide, line, text), lines counted from 0.

    ``item`` and ``fm`` are prefixes of lines, the first line counts; ``cause`` and ``action`` are first lines of
    slides, the first such slide counts: all its causes, the first of its actions.
    """
    at = F.struct("slide", "line")
    after = lambda p: _filled(F.min_by(F.substr("text", F.lit(len(p) + 1)), F.when(F.col("text").startswith(p), at)))
    anchors = lines.groupBy("doc").agg(after(item).alias("item"), after(fm).alias("fm"))
    sections = lines.where((F.col("line") == 0) & F.col("text").isin(cause, action)).groupBy("doc", F.col("text").alias("section")).agg(F.min("slide").alias("slide"))
    body = lines.where("line > 0").join(sections, ["doc", "slide"])
    causes = body.where((F.col("section") == cause) & is_cause(F.col("text"))).select("doc", _filled(F.col("text")).alias("cause"))
    actions = body.where((F.col("section") == action) & (F.col("line") == 1)).select("doc", _filled(F.col("text")).alias("action"))
    found = _links(anchors.join(actions, "doc", "left"), [("item", "HAS_FAILURE", "fm"), ("fm", "MITIGATED_BY", "action")], "doc")
    return found.unionByName(_links(anchors.join(causes, "doc"), [("fm", "CAUSED_BY", "cause")], "doc")).distinct()


def report_links(paragraphs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``doc, src, rel, dst`` by name from paragraphs (doc, pos, text) "key: value"; of equal keys the last counts.

    ``names``: role (item, fm, cause, action) to key.  Without a failure mode the action belongs to the cause.
    """
    pattern = r"^([^:：]+)[:：]\s*(.*)$"
    rows = paragraphs.where(F.col("text").rlike(pattern)).select("doc", "pos", F.trim(F.regexp_extract("text", pattern, 1)).alias("k"), F.regexp_extract("text", pattern, 2).alias("v"))
    wide = rows.groupBy("doc").agg(*(_filled(F.max_by("v", F.when(F.col("k") == key, F.col("pos")))).alias(role) for role, key in names.items()))
    wide = wide.withColumn("anchor", F.coalesce("fm", "cause"))
    return _links(wide, [("item", "HAS_FAILURE", "fm"), ("fm", "CAUSED_BY", "cause"), ("anchor", "MITIGATED_BY", "action")], "doc")


def extraction_delta(records: DataFrame, existing: DataFrame, types: Sequence[str], rels: Sequence[str], rel: str = "EVIDENCED_BY") -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, id, type, label, new) and edges (doc, src, rel, dst) out of model answers, nothing invented.

    ``records``: doc, entities (type, id, label), relations (srcLabel, rel, dstLabel); ``existing``: id, type, label, ord.
    An entity is the node that its id or else its folded label names, or a new one with an id made from type and
    label.  Relations bind by folded label, existing nodes first, then the first entity of the document; unbound
    ones, loops and other types and relations are left out.  New nodes are evidenced by their document.
    """
    known = existing.select(F.col("id").alias("known"), F.col("type").alias("known_type"), F.col("label").alias("known_label"))
    keys = first_per_key(existing.where("type <> 'doc'").withColumn("k", fold(F.col("label"))).where("k <> ''"), ["k"], "ord").select("k", F.col("id").alias("of_label"))
    found = records.select("doc", F.posexplode("entities").alias("i", "e")).select("doc", "i", "e.type", F.col("e.id").alias("given"), F.trim("e.label").alias("raw")).where(F.col("type").isin(*types))
    found = found.withColumn("k", fold(F.col("raw"))).join(known.select(F.col("known").alias("given")).distinct().withColumn("real", F.lit(True)), "given", "left").join(keys, "k", "left")
    made = F.when(F.col("k") != "", auto_id(F.col("type"), F.col("raw")))
    found = found.withColumn("id", F.coalesce(F.when(F.col("real"), F.col("given")), "of_label", made)).where("id is not null")
    found = found.join(known, found["id"] == known["known"], "left").withColumn("label", F.coalesce("known_label", "raw"))
    nodes = first_per_key(found, ["doc", "id"], "i").select("doc", "id", F.coalesce("known_type", "type").alias("type"), "label", F.col("known").isNull().alias("new"))
    names = found.select("doc", "i", "id", F.explode(F.array("label", "raw")).alias("name")).withColumn("k", fold(F.col("name"))).where("k <> ''")
    own = first_per_key(names, ["doc", "k"], "i").select("doc", "k", F.col("id").alias("of_doc"))
    links = records.select("doc", F.explode("relations").alias("r")).where(F.col("r.rel").isin(*rels)).select("doc", "r.rel", fold(F.col("r.srcLabel")).alias("s"), fold(F.col("r.dstLabel")).alias("t"))
    for key, end in (("s", "src"), ("t", "dst")):
        links = links.withColumnRenamed(key, "k").join(keys, "k", "left").join(own, ["doc", "k"], "left").withColumn(end, F.coalesce("of_label", "of_doc")).drop("k", "of_label", "of_doc")
    edges = links.where("src is not null and dst is not null and src <> dst").select("doc", "src", "rel", "dst").distinct()
    proof = nodes.where("new").select("doc", F.col("id").alias("src"), F.lit(rel).alias("rel"), F.col("doc").cast("string").alias("dst"))
    return nodes, edges.unionByName(proof)


def extraction_summary(links: DataFrame) -> DataFrame:
    """``file, objects, relations`` from asserted links (file, src, rel, dst): distinct objects, links with repeats."""
    ends = links.select("file", F.explode(F.array("src", "dst")).alias("id")).groupBy("file").agg(F.count_distinct("id").alias("objects"))
    return links.groupBy("file").agg(F.count("*").alias("relations")).join(ends, "file")


def source_list(sources: DataFrame, links: DataFrame, shown: int = 120) -> DataFrame:
    """``file, kind, size, preview, objects, relations``: every registered source (file, kind, text) with what was drawn from it.

    links: asserted links (file, src, rel, dst); sources that gave none stay, with zeros.
    """
    rows = sources.select("file", "kind", F.length("text").alias("size"), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, shown).alias("preview"))
    rows = rows.join(extraction_summary(links), "file", "left")
    return rows.select("file", "kind", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("preview", F.lit("")).alias("preview"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("objects", "relations")))
