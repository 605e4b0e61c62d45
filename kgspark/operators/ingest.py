"""From extracted rows and texts to nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import auto_id, entity_id, fold, nospace

from .graph import first_per_key
from .lineage import settle
from .phrases import PART, held

# Confidence of each way to recognise a name, best first.
WAYS = (("id", 1.0), ("label", 0.95), ("code", 0.72), ("synonym", 0.82))


def keys(vocabulary: DataFrame) -> DataFrame:
    """``key, id, way, confidence, rank, ord`` from a vocabulary (id, label, codes, synonyms, ord): all names of a term."""
    parts = []
    for rank, (way, score) in enumerate(WAYS):
        name = {"id": F.array("id"), "label": F.array("label"), "code": F.col("codes"), "synonym": F.col("synonyms")}[way]
        parts.append(vocabulary.select(F.explode(name).alias("name"), "id", F.lit(way).alias("way"), F.lit(score).alias("confidence"), F.lit(rank).alias("rank"), "ord"))
    return reduce(DataFrame.unionByName, parts).select(fold(F.col("name")).alias("key"), "id", "way", "confidence", "rank", "ord").where("key <> ''")


def normalised(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``raw, id, way, confidence`` of each name (raw): the best way it is known, nulls if it is not.  One equality join."""
    asked = names.select("raw").distinct().withColumn("key", fold(F.col("raw")))
    best = first_per_key(asked.join(keys(vocabulary), "key"), ["raw"], "rank", "ord")
    return asked.select("raw").join(best.select("raw", "id", "way", "confidence"), "raw", "left")


def resolve_or_create(names: DataFrame, vocabulary: DataFrame, confidence: float = 0.66) -> DataFrame:
    """``raw, type, id, way, confidence`` of (raw, type): known ids, else one made from type and folded name."""
    found = names.select("raw", "type").distinct().join(normalised(names, vocabulary), "raw", "left")
    new = F.col("id").isNull()
    return found.select(
        "raw", "type", F.coalesce("id", auto_id(F.col("type"), F.col("raw"))).alias("id"), F.when(new, "new").otherwise(F.col("way")).alias("way"), F.when(new, confidence).otherwise(F.col("confidence")).alias("confidence")
    )


def scan_entities(texts: DataFrame, vocabulary: DataFrame, least: int = 2, part: int = PART) -> DataFrame:
    """Distinct ``doc, id`` for the vocabulary names that a text (doc, text) holds, blanks not counted; one walk over each text."""
    words = vocabulary.select("id", F.explode(F.concat(F.array("label"), "synonyms")).alias("name")).select("id", nospace(F.col("name")).alias("word")).where(F.length("word") >= least).distinct()
    found = held(texts.select("doc", nospace(F.col("text")).alias("t")), words, part)
    return found.join(words, "word").select("doc", "id").distinct()


def resolved_texts(asked: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """``q, id``: the node (id, label, ord) that a text (q) names: an equal label first, else one of two that holds the other; ties by ``ord``.

    Both ways are walks: over the texts for the labels that they hold, over the labels for the texts.
    """
    texts = asked.select("q", F.lower("q").alias("l")).distinct()
    rows = nodes.select("id", "ord", F.lower("label").alias("l"))
    exact = texts.join(rows, "l").select("q", "id", "ord", F.lit(0).alias("rank"))
    long = texts.where(F.length("l") >= least)
    names = rows.where(F.length("l") >= least)
    within = held(long.select("q", F.col("l").alias("t")), names.select(F.col("l").alias("word"))).join(names.withColumnRenamed("l", "word"), "word")
    around = held(names.select("id", "ord", F.col("l").alias("t")), long.select(F.col("l").alias("word"))).join(long.withColumnRenamed("l", "word"), "word")
    part = within.select("q", "id", "ord").unionByName(around.select("q", "id", "ord")).withColumn("rank", F.lit(1))
    return exact.unionByName(part).groupBy("q").agg(F.min_by("id", F.struct("rank", "ord")).alias("id"))


def co_mentions(mentions: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct ``src, rel, dst`` between objects of two types in one document, from mentions (doc, id, type).

    pairs: (source type, relation, target type).
    """
    out = []
    for source, rel, target in pairs:
        one = mentions.where(F.col("type") == source).select("doc", F.col("id").alias("src"))
        other = mentions.where(F.col("type") == target).select("doc", F.col("id").alias("dst"))
        out.append(one.join(other, "doc").where("src <> dst").select("src", F.lit(rel).alias("rel"), "dst"))
    return reduce(DataFrame.unionByName, out).distinct()


#: What a free text links: between objects of these types that it mentions, and without a failure mode, between these.
FREE_LINKS = [("item", "HAS_FAILURE", "fm"), ("fm", "CAUSED_BY", "cause"), ("fm", "MITIGATED_BY", "action")]
FREE_LINKS_WITHOUT_FAILURE = [("item", "MITIGATED_BY", "action"), ("cause", "MITIGATED_BY", "action")]


def stated_fields(texts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``doc, type, raw``: values of "key: value" stretches in free texts (doc, text), each up to its first comma, dot or slash.

    fields: type -> pattern of its keys.
    """
    found = None
    for kind, keys in fields.items():
        values = F.regexp_extract_all("text", F.lit(rf"(?:{keys})\s*[:：]\s*([^\n:：]+)"), F.lit(1))
        one = texts.select("doc", F.lit(kind).alias("type"), F.explode(values).alias("v"))
        found = one if found is None else found.unionByName(one)
    return found.select("doc", "type", F.trim(F.split(F.trim("v"), "[,·/]")[0]).alias("raw")).where("raw <> ''").distinct()


def free_text_links(texts: DataFrame, vocabulary: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Distinct ``doc, src, rel, dst`` that free texts (doc, text) of one issue each suggest.

    Objects are the names of the vocabulary (id, type, label, codes, synonyms, ord) that a text holds, and what its fields state, known or new.
    Those of two types are linked; a text without a failure mode links its parts and causes to its measures.
    """
    scanned = scan_entities(texts, vocabulary).join(vocabulary.select("id", "type").distinct(), "id").select("doc", "id", "type")
    stated = stated_fields(texts, fields)
    named = stated.join(resolve_or_create(stated, vocabulary).select("raw", "type", "id"), ["raw", "type"]).select("doc", "id", "type")
    mentions = settle(scanned.unionByName(named).distinct())
    failing = mentions.where("type = 'fm'").select("doc").distinct()
    out = []
    for rows, links in ((mentions, FREE_LINKS), (mentions.join(failing, "doc", "left_anti"), FREE_LINKS_WITHOUT_FAILURE)):
        for source, rel, target in links:
            one = rows.where(F.col("type") == source).select("doc", F.col("id").alias("src"))
            out.append(one.join(rows.where(F.col("type") == target).select("doc", F.col("id").alias("dst")), "doc").select("doc", "src", F.lit(rel).alias("rel"), "dst"))
    return reduce(DataFrame.unionByName, out).distinct()


def with_free_text(links: DataFrame, texts: DataFrame, vocabulary: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``doc, src, rel, dst, way``: the links that documents state in their form (by name), and of those that state none what their text (doc, text) suggests (by id)."""
    silent = texts.join(links.select("doc").distinct(), "doc", "left_anti")
    return links.select("doc", "src", "rel", "dst", F.lit("stated").alias("way")).unionByName(free_text_links(silent, vocabulary, fields).withColumn("way", F.lit("free text")))


def scanned_where_silent(texts: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct ``doc, id``: known objects in the texts (doc, text) of drawings that have no labels (doc) of their own."""
    silent = texts.join(labels.select("doc").distinct(), "doc", "left_anti")
    return scan_entities(silent.select("doc", "text"), vocabulary)


def worksheet_edges(rows: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct ``src, rel, dst`` from wide rows of ids; columns: (source column, relation, target column); blanks give none."""
    each = [F.struct(F.col(s).alias("src"), F.lit(r).alias("rel"), F.col(t).alias("dst")) for s, r, t in columns]
    return rows.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("src is not null and dst is not null and src <> '' and dst <> ''").distinct()


def matched_columns(headers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``file, role, name``: header (file, c, name) of each role (role, synonym, ord): an equal name before one that holds it, then the first column."""
    folded = headers.withColumn("h", fold(F.col("name")))
    words = F.broadcast(synonyms.withColumn("s", fold(F.col("synonym"))))
    hits = folded.join(words, F.col("h").contains(F.col("s"))).withColumn("rank", F.when(F.col("h") == F.col("s"), 0).otherwise(1))
    return first_per_key(hits, ["file", "role"], "rank", "ord", "c").select("file", "role", "name")


def detected_header(cells: DataFrame, synonyms: DataFrame, within: int = 15, core: tuple[str, ...] = ("item", "fm")) -> DataFrame:
    """``file, sheet, row, span, roles``: the one or two rows among the first ``within`` that name most roles, the core ones among them."""
    words = F.broadcast(synonyms.select("role", fold(F.col("synonym")).alias("s")))
    named = cells.where(F.col("r") < within).withColumn("h", fold(F.col("value"))).join(words, F.col("h").contains(F.col("s"))).select("file", "sheet", "r", "role").distinct()
    one = named.select("file", "sheet", F.col("r").alias("row"), "role", F.lit(1).alias("span"))
    two = named.select("file", "sheet", F.explode(F.array("r", F.col("r") - 1)).alias("row"), "role", F.lit(2).alias("span")).where("row >= 0").distinct()
    found = one.unionByName(two).groupBy("file", "sheet", "row", "span").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    found = found.withColumns({"core": F.size(F.array_intersect("roles", F.array(*(F.lit(x) for x in core)))), "n": F.size("roles")}).where(F.col("core") == len(core))
    return first_per_key(found, ["file", "sheet"], F.desc("core"), F.desc("n"), "span", "row").select("file", "sheet", "row", "span", "roles")


def extraction_to_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, ord) and edges (src, rel, dst) from extraction records (doc, entities, relations).

    Ids come from type and label, the first of each counts; a relation binds to the first entity of its document with
    that folded label; what cannot be bound, and loops, are left out.
    """
    found = records.select("doc", F.posexplode("entities").alias("i", "e")).select("doc", "i", F.col("e.type").alias("type"), F.col("e.label").alias("label")).where("trim(label) <> ''")
    found = found.withColumn("id", entity_id(F.col("type"), F.col("label")))
    nodes = first_per_key(found, ["id"], "doc", "i").select("id", "type", "label", F.struct("doc", "i").alias("ord"))
    bound = first_per_key(found.withColumn("k", fold(F.col("label"))), ["doc", "k"], "i").select("doc", "k", "id")
    links = records.select("doc", F.explode("relations").alias("r")).select("doc", fold(F.col("r.srcLabel")).alias("s"), F.col("r.rel").alias("rel"), fold(F.col("r.dstLabel")).alias("t"))
    links = links.join(bound.select("doc", F.col("k").alias("s"), F.col("id").alias("src")), ["doc", "s"]).join(bound.select("doc", F.col("k").alias("t"), F.col("id").alias("dst")), ["doc", "t"])
    return nodes, links.where("src <> dst").select("src", "rel", "dst").distinct()


def document_nodes(contributions: DataFrame, rel: str = "EVIDENCED_BY") -> tuple[DataFrame, DataFrame]:
    """Document nodes with their first object as parent, and evidence edges, from contributions (file, id, ord)."""
    doc = F.concat(F.lit("DOC_"), fold(F.col("file")))
    nodes = contributions.groupBy("file").agg(F.min_by("id", F.struct("ord", "id")).alias("parent")).select(doc.alias("id"), F.lit("doc").alias("type"), F.col("file").alias("label"), "parent")
    return nodes, contributions.select(F.col("id").alias("src"), F.lit(rel).alias("rel"), doc.alias("dst")).distinct()


def grid_rows(texts: DataFrame, gap: float = 2.0) -> DataFrame:
    """Texts of a drawing (file, x, y, value) with ``row``: values whose heights differ by at most ``gap`` from the one before stand in one row."""
    order = Window.partitionBy("file").orderBy(F.desc("y"), "x")
    new = F.when(F.lag("y").over(order) - F.col("y") <= gap, 0).otherwise(1)
    return texts.withColumn("_new", new).withColumn("row", F.sum("_new").over(order)).drop("_new")


def nearest_column(values: DataFrame, heads: DataFrame) -> DataFrame:
    """``file, row, name, value``: each value under the header (file, x, name) nearest to its x."""
    met = values.join(heads.select("file", F.col("x").alias("_x"), "name"), "file").withColumn("_d", F.abs(F.col("x") - F.col("_x")))
    return first_per_key(met, ["file", "row", "x", "value"], "_d", "_x").select("file", "row", "name", "value")


def near_pairs(texts: DataFrame, one: Column, other: Column, most: float) -> DataFrame:
    """``file, one, other, distance`` of texts (file, x, y, value) of two kinds closer than ``most``.

    Texts meet only within their cell of a grid of that width and the eight around it.
    """
    cell = lambda v: F.floor(F.col(v) / most)
    a = texts.where(one).select("file", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("value").alias("one")).withColumns({"cx": cell("ax"), "cy": cell("ay")})
    b = texts.where(other).select("file", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("value").alias("other"))
    around = F.sequence(F.lit(-1), F.lit(1))
    b = b.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": cell("bx") + F.col("dx"), "cy": cell("by") + F.col("dy")})
    met = a.join(b, ["file", "cx", "cy"]).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    return met.where(F.col("distance") < most).select("file", "one", "other", "distance")


def standard_records(extractions: DataFrame) -> DataFrame:
    """Documents as flat rows with a lossless JSON record, from (doc, file, doc_type, summary, entities, relations)."""
    record = F.to_json(F.struct(F.struct("file", "doc_type").alias("source"), "summary", "entities", "relations"))
    return extractions.select("doc", "doc_type", "summary", F.size("entities").alias("entities"), F.size("relations").alias("relations"), record.alias("record"))
