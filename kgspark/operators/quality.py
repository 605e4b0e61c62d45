"""Audits of the graph.  Findings are rows ``kind, id, other, confidence``; nothing is changed or blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import fold, half_up, is_subset, starts_as_number, tokens

from .graph import evidence, first_per_key, ids, with_degree
from .lineage import settle

NODE = ["canvas_id", "id"]


def finding(df: DataFrame, kind: str, confidence: Column | int, other: Column | None = None) -> DataFrame:
    """Rows of the common shape; ``other`` is a second node, relation or property."""
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("canvas_id", F.lit(kind).alias("kind"), "id", (other if other is not None else F.lit(None)).cast("string").alias("other"), value.cast("int").alias("confidence"))


def proven(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of nodes that a document stands behind, with how many."""
    return evidence(nodes, edges).groupBy(*NODE).agg(F.count("*").alias("docs"))


def _rarest(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Of each row (id and tokens, exploded as ``t``) the token that the fewest of ``held`` (canvas_id, type, t) have, if all are there."""
    often = held.groupBy("canvas_id", "type", "t").agg(F.count("*").alias("n"))
    met = rows.join(often, ["canvas_id", "type", "t"])
    least = met.groupBy("canvas_id", "type", "key").agg(F.min_by("t", F.struct("n", "t")).alias("t"), F.count("*").alias("met"), F.first("size").alias("size"))
    return least.where("met = size").select("canvas_id", "type", "key", "t")


def auto_duplicates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Automatic nodes that look like a regular one of their type: equal when folded (92), else one's tokens within the other's (45).

    Folded labels meet by an equality join.  Token sets meet over the rarest token of the smaller set, and only if the other
    side knows all of its tokens, so that a word that all labels share brings no pairs together.
    """
    objects = nodes.where("type <> 'doc'").select("canvas_id", "id", "type", "ord", fold(F.col("label")).alias("fold"), tokens(F.col("label")).alias("tokens"))
    auto = objects.where("id like 'AUTO\\\\_%'").join(proven(nodes, edges), NODE, "left_semi")
    # of regular nodes with one label only the first can win
    regular = objects.where("id not like 'AUTO\\\\_%'").groupBy("canvas_id", "type", F.col("fold").alias("r_fold"), F.col("tokens").alias("r_tokens"))
    regular = settle(regular.agg(F.min_by("id", "ord").alias("r_id"), F.min("ord").alias("r_ord")))
    auto = settle(auto)
    exact = auto.join(regular, (auto.canvas_id == regular.canvas_id) & (auto.type == regular.type) & (F.col("fold") == F.col("r_fold"))).select(auto.canvas_id, "id", "r_id", "r_ord", F.lit(92).alias("score"))
    one = auto.select("canvas_id", "type", F.col("tokens").alias("key"), F.size("tokens").alias("size")).distinct().withColumn("t", F.explode("key"))
    other = regular.select("canvas_id", "type", F.col("r_tokens").alias("key"), F.size("r_tokens").alias("size")).distinct().withColumn("t", F.explode("key"))
    names = lambda df, key: df.select("canvas_id", "type", "t", F.col("key").alias(key))
    within = names(_rarest(one, other), "tokens").join(names(other, "r_tokens"), ["canvas_id", "type", "t"]).where(is_subset(F.col("tokens"), F.col("r_tokens")))
    around = names(_rarest(other, one), "r_tokens").join(names(one, "tokens"), ["canvas_id", "type", "t"]).where(is_subset(F.col("r_tokens"), F.col("tokens")))
    sets = within.unionByName(around).select("canvas_id", "type", "tokens", "r_tokens").distinct()
    # of the regular nodes with a token set the first wins
    firsts = regular.groupBy("canvas_id", "type", "r_tokens").agg(F.min_by("r_id", "r_ord").alias("r_id"), F.min("r_ord").alias("r_ord"))
    winner = sets.join(firsts, ["canvas_id", "type", "r_tokens"]).groupBy("canvas_id", "type", "tokens").agg(F.min_by("r_id", "r_ord").alias("r_id"), F.min("r_ord").alias("r_ord"))
    loose = auto.join(winner, ["canvas_id", "type", "tokens"]).select("canvas_id", "id", "r_id", "r_ord", F.lit(45).alias("score"))
    best = first_per_key(exact.unionByName(loose), NODE, F.desc("score"), "r_ord")
    return finding(best, "dup-candidate", F.col("score"), F.col("r_id"))


def label_duplicates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Regular nodes with the same folded label as a better linked one of their type (88)."""
    rows = nodes.where("type <> 'doc' and id not like 'AUTO\\\\_%'").select("canvas_id", "id", "type", fold(F.col("label")).alias("fold")).where("fold <> ''")
    ranked = with_degree(rows, edges)
    rank = F.struct((-F.col("degree")).alias("d"), F.length("id").alias("l"), F.col("id").alias("i"))
    winners = ranked.groupBy("canvas_id", "type", "fold").agg(F.min_by("id", rank).alias("winner"))
    lost = ranked.join(winners, ["canvas_id", "type", "fold"]).where("id <> winner")
    return finding(lost.join(proven(nodes, edges), NODE, "left_semi"), "dup-candidate", 88, F.col("winner"))


def orphans(nodes: DataFrame, edges: DataFrame, rel: str = "EVIDENCED_BY") -> DataFrame:
    """Objects that have documents but no relation to another object (55)."""
    linked = edges.where(F.col("rel") != rel).select("canvas_id", F.explode(F.array("src", "dst")).alias("id"))
    alone = nodes.where("type <> 'doc'").select(*NODE).join(linked, NODE, "left_anti").join(proven(nodes, edges), NODE, "left_semi")
    return finding(alone, "orphan", 55)


def without_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects that no document stands behind (70)."""
    return finding(nodes.where("type <> 'doc'").select(*NODE).join(proven(nodes, edges), NODE, "left_anti"), "no-evidence", 70)


def master_gaps(nodes: DataFrame, edges: DataFrame, severity: Column, least: int = 6, floor: int = 40) -> DataFrame:
    """Severe failure modes without a standard, directly or over a cause, that have documents and a relation."""
    fms = nodes.where("type = 'fm'").withColumn("s", severity).where(F.col("s") >= least).select(*NODE, "s")
    standard = edges.where("rel = 'REF_MASTER'").select("canvas_id", F.col("src").alias("id"))
    over = edges.where("rel = 'CAUSED_BY'").select("canvas_id", "src", F.col("dst").alias("id")).join(standard, NODE, "left_semi").select("canvas_id", F.col("src").alias("id"))
    related = edges.where("rel = 'HAS_FAILURE'").select("canvas_id", F.col("dst").alias("id")).unionByName(edges.where("rel = 'CAUSED_BY'").select("canvas_id", F.col("src").alias("id")))
    open_ = fms.join(standard.unionByName(over), NODE, "left_anti").join(related, NODE, "left_semi").join(proven(nodes, edges), NODE)
    share = 0.5 * F.least(F.col("s") / 10, F.lit(1.0)) + 0.3 * F.least(F.col("docs") / 10, F.lit(1.0)) + 0.1
    return finding(open_.withColumn("c", half_up(F.least(share, F.lit(1.0)) * 100)).where(F.col("c") >= floor), "master-missing", F.col("c"))


def relation_domains(nodes: DataFrame, edges: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Edges whose ends have types outside the relation's lists; an empty list allows all, unknown relations are skipped (85)."""
    kind = lambda end: nodes.select("canvas_id", F.col("id").alias(end), F.col("type").alias(f"{end}_type"))
    rows = edges.join(F.broadcast(relation_types.withColumnRenamed("rel_id", "rel")), ["canvas_id", "rel"]).join(kind("src"), ["canvas_id", "src"]).join(kind("dst"), ["canvas_id", "dst"])
    allowed = lambda end: (F.size(f"{end}_types") == 0) | F.array_contains(f"{end}_types", F.col(f"{end}_type"))
    bad = rows.where(~(allowed("src") & allowed("dst"))).withColumn("id", F.col("src"))
    return finding(bad, "rel-domain", 85, F.concat_ws("→", "rel", "dst"))


def undefined_subtypes(nodes: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Objects with a subtype that their type does not define (80)."""
    rows = nodes.where("type <> 'doc' and st is not null and st <> ''").select("canvas_id", "id", "type", "st")
    return finding(rows.join(F.broadcast(subtypes.select("canvas_id", "type", "st")), ["canvas_id", "type", "st"], "left_anti"), "bad-subtype", 80, F.col("st"))


def missing_properties(nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """Objects without a required property (60)."""
    need = F.broadcast(defs.where("required").select("canvas_id", "type", "key"))
    rows = nodes.where("type <> 'doc'").join(need, ["canvas_id", "type"])
    return finding(rows.where(~F.exists("props", lambda p: p["k"] == F.col("key"))), "missing-prop", 60, F.col("key"))


def bad_datatypes(nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """Values of defined properties that are no number, or not among the options (70)."""
    rows = nodes.where("type <> 'doc'").select("canvas_id", "id", "type", F.explode("props").alias("p"))
    rows = rows.select("canvas_id", "id", "type", F.col("p.k").alias("key"), F.trim(F.coalesce("p.v", F.lit(""))).alias("v"))
    typed = rows.join(F.broadcast(defs.where("datatype <> 'text'")), ["canvas_id", "type", "key"])
    bad = F.when(F.col("datatype") == "number", ~starts_as_number(F.col("v"))).otherwise(~F.array_contains("options", F.col("v")))
    return finding(typed.where(bad), "bad-datatype", 70, F.col("key"))


def combined(*found: DataFrame, semantic: DataFrame | None = None, floor: int = 40, cap: int | None = None) -> DataFrame:
    """All findings above the floor, the best ``cap`` of each kind if a cap is asked for.

    ``semantic`` holds pairs that are close in meaning; a pair that stays among the findings by spelling is not told again.
    """
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = capped(rows.where(F.col("confidence") >= floor), cap)
    if semantic is None:
        return rows
    told = rows.where("kind = 'dup-candidate'").select("canvas_id", "id", "other")
    more = capped(semantic.where(F.col("confidence") >= floor).join(told, ["canvas_id", "id", "other"], "left_anti"), cap)
    return rows.unionByName(more.select(*rows.columns))


def capped(rows: DataFrame, cap: int | None) -> DataFrame:
    if cap is None:
        return rows
    place = Window.partitionBy("canvas_id", "kind").orderBy(F.desc("confidence"), "id", "other")
    return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= cap).drop("_place")


def classify(nodes: DataFrame, subtypes: DataFrame) -> DataFrame:
    """``canvas_id, id, st``: subtype with most keywords in the label, for unclassified objects; ties by definition order.

    ``subtypes``: canvas_id, type, st, keywords, ord.
    """
    rows = nodes.where("type <> 'doc' and (st is null or st = '')").select("canvas_id", "id", "type", F.lower(F.concat_ws(" ", "label", "sub")).alias("text"))
    subtypes = F.broadcast(subtypes.select("canvas_id", "type", F.col("st").alias("new"), "keywords", F.col("ord").alias("place")))
    hits = rows.join(subtypes, ["canvas_id", "type"]).withColumn("n", F.size(F.filter("keywords", lambda w: F.col("text").contains(F.lower(w)))))
    best = hits.where("n > 0").groupBy(*NODE).agg(F.max_by("new", F.struct("n", (-F.col("place")).alias("p"))).alias("st"))
    return best


def semantic_duplicates(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, most: float = 0.15) -> DataFrame:
    """Pairs (canvas_id, id, near, distance) that are close but spelled differently (50): the weaker node and the stronger.

    ``pairs`` may come from any search; a node without documents is left to another rule.
    """
    side = lambda a, p: with_degree(nodes.where("type <> 'doc'").select("canvas_id", "id", "type", fold(F.col("label")).alias("fold")), edges).select("canvas_id", F.col("id").alias(a), *(F.col(c).alias(p + c) for c in ("type", "fold", "degree")))
    rows = pairs.where(F.col("distance") < most).join(side("id", "a_"), NODE).join(side("near", "b_"), ["canvas_id", "near"])
    rows = rows.where("a_type = b_type and a_fold <> b_fold and not (id like 'AUTO\\\\_%' and near like 'AUTO\\\\_%')")
    key = lambda i, p: F.struct(F.when(F.col(i).startswith("AUTO_"), 1).otherwise(0).alias("auto"), (-F.col(p + "degree")).alias("d"), F.length(i).alias("l"), F.col(i).alias("i"))
    first = key("id", "a_") < key("near", "b_")
    rows = rows.select("canvas_id", F.when(first, F.col("near")).otherwise(F.col("id")).alias("id"), F.when(first, F.col("id")).otherwise(F.col("near")).alias("into"))
    return finding(rows.join(ids(proven(nodes, edges), "id"), NODE, "left_semi"), "dup-semantic", 50, F.col("into"))
