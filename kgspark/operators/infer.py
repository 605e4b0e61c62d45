"""Rule-based inference over the graph, for many design conditions at once.

Conditions: ``cid, seed`` (a project id, or null), ``market``, ``light``, ``shape`` (phrases), ``components``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import domain
from kgspark.functions.text import clamp01, half_up, hop

from .graph import both_ways, evidence, first_per_key
from .lineage import in_blocks, settle
from .phrases import held

# Weights of similarity and conditions, and boosts of the confidence.
SIMILAR_WEIGHT, CONDITION_WEIGHT = 0.65, 0.35
BOOST = {"market": 0.08, "shape": 0.06, "component": 0.04, "cause": 0.1}


def node_text(nodes: DataFrame) -> DataFrame:
    """``canvas_id, id, ord, text``: label, subtitle and all properties of a node."""
    props = F.array_join(F.transform("props", lambda p: F.concat_ws(" ", p["k"], p["v"])), " ")
    return nodes.select("canvas_id", "id", "ord", F.concat_ws(" ", "label", F.coalesce("sub", F.lit("")), props).alias("text"))


def shape_tokens(shape: Column) -> Column:
    return F.filter(F.flatten(F.transform(shape, lambda s: F.split(s, r"\s+"))), lambda t: F.length(t) >= 2)


def condition_match(text: Column) -> Column:
    """Share of a condition's light, shape tokens and market that a project's text holds."""
    tokens = shape_tokens(F.col("shape"))
    light = F.when((F.length("light") > 0) & text.contains(F.col("light")), 1).otherwise(0)
    market = F.when(domain.holds_any(text, domain.market_words(F.col("market"))), 1).otherwise(0)
    return (light + market + F.size(F.filter(tokens, lambda t: text.contains(t)))) / (2 + F.size(tokens))


def _slots(features: DataFrame) -> DataFrame:
    """``fid, slot, word``: what a text may hold for each feature set; a slot counts once, whichever of its words is held."""
    one = lambda slot, words: F.transform(words, lambda w: F.struct(F.lit(slot).alias("slot"), w.alias("word")))
    shape = F.transform(shape_tokens(F.col("shape")), lambda w, i: F.struct(F.concat(F.lit("shape"), i.cast("string")).alias("slot"), w.alias("word")))
    every = F.concat(one("light", F.array("light")), one("market", domain.market_words(F.col("market"))), shape)
    return features.select("fid", F.explode(every).alias("s")).select("fid", "s.*").where(F.length("word") > 0)


def matched_texts(features: DataFrame, texts: DataFrame) -> DataFrame:
    """``fid, canvas_id, id, ord, match``: texts (canvas_id, id, ord, text) that hold anything of a feature set (fid, light, market, shape).

    One walk over each text finds the words that it holds.
    """
    slots = settle(_slots(features))
    found = held(texts.select("canvas_id", "id", "ord", F.col("text").alias("t")), slots.select("word"))
    counted = found.select("canvas_id", "id", "ord", "word").join(slots, "word").groupBy("fid", "canvas_id", "id", "ord").agg(F.count_distinct("slot").alias("hits"))
    size = features.select("fid", (2 + F.size(shape_tokens(F.col("shape")))).alias("slots"))
    return counted.join(size, "fid").select("fid", "canvas_id", "id", "ord", (F.col("hits") / F.col("slots")).alias("match"))


def scored_projects(conditions: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """``cid, id, sim, place``: projects most like each condition.

    The projects that the seed is SIMILAR to count by 0.65 of the link and 0.35 of the condition match; only where
    there are none, all projects count by their match.  That is worked out once for each different set of features, of
    whose projects one more than asked for is kept, as a condition's own seed does not count.
    """
    texts = settle(node_text(nodes.where("type = 'proj'")))
    links = edges.where("rel like 'SIMILAR%'").select("canvas_id", F.col("src").alias("seed"), F.col("dst").alias("id"), F.coalesce("weight", F.lit(0.5)).alias("w"), F.col("ord").alias("link"))
    links = first_per_key(links, ["canvas_id", "seed", "id"], "link")
    linked = conditions.join(links, "seed").join(texts, ["canvas_id", "id"])
    linked = settle(linked.select("cid", "id", clamp01(SIMILAR_WEIGHT * F.col("w") + CONDITION_WEIGHT * condition_match(F.col("text"))).alias("sim"), F.col("link").alias("o")))
    fid = F.to_json(F.struct("light", "market", "shape"))
    other = conditions.join(linked.select("cid").distinct(), "cid", "left_anti").withColumn("fid", fid)
    features = settle(other.select("fid", "light", "market", "shape").distinct())
    place = F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("match"), "ord"))
    best = matched_texts(features, texts).withColumn("n", place).where(F.col("n") <= top + 1)
    other = other.join(best, "fid").where(~F.col("id").eqNullSafe(F.col("seed"))).select("cid", "id", F.col("match").alias("sim"), F.col("ord").alias("o"))
    order = Window.partitionBy("cid").orderBy(F.desc("sim"), "o")
    return linked.unionByName(other).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("cid", "id", "sim", "place")


def visits(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """``cid, anchor, fm, sim, turn``: failure modes that occurred in the projects of a condition, in the order in which they are met."""
    struck = edges.where("rel = 'OCCURRED_IN'").select(F.col("src").alias("id"), F.col("dst").alias("fm"), "ord")
    return projects.join(struck, "id").select("cid", F.col("id").alias("anchor"), "fm", "sim", F.struct("place", "ord").alias("turn"))


def item_visits(items: DataFrame, edges: DataFrame, sim: float = 0.9) -> DataFrame:
    """The same with chosen items (cid, id) as anchors, over HAS_FAILURE."""
    failed = edges.where("rel = 'HAS_FAILURE'").select(F.col("src").alias("id"), F.col("dst").alias("fm"), "ord")
    return items.join(failed, "id").select("cid", F.col("id").alias("anchor"), "fm", F.lit(sim).alias("sim"), F.struct(F.lit(1).alias("place"), "ord").alias("turn"))


def concerns(visited: DataFrame, conditions: DataFrame, nodes: DataFrame, edges: DataFrame, severity: Column, boost_once: bool = False, extra: Column | None = None, rel: str = "OCCURRED_IN") -> DataFrame:
    """One row per condition and failure mode with confidence, its terms, trace, the first visit (``turn``) and the likeness of the anchor.

    Boosts add up over visits, as each visit expands the failure mode again; ``boost_once`` counts them once.  ``extra`` is a boost that counts once,
    out of ``title`` and ``shape``; ``rel`` is the relation that anchors have to failure modes.
    """
    fms = nodes.where("type = 'fm'").select("canvas_id", F.col("id").alias("fm"), severity.alias("severity"), F.col("label").alias("title"))
    docs = evidence(nodes, edges).groupBy(F.col("id").alias("fm")).agg(F.count("*").alias("docs"))
    causes = edges.where("rel = 'CAUSED_BY'").select(F.col("src").alias("fm"), F.col("dst").alias("cause"))
    standard = edges.where("rel = 'REF_MASTER'").select(F.col("src").alias("s"))
    mastered = causes.join(standard, F.col("cause") == F.col("s"), "left_semi").select("fm").unionByName(standard.select(F.col("s").alias("fm"))).distinct().withColumn("mastered", F.lit(True))
    regs = edges.where("rel = 'UNDER_REG'").select(F.col("src").alias("fm"), F.col("dst").alias("id")).join(nodes.select("id", F.col("label").alias("reg")), "id")
    regs = regs.groupBy("fm").agg(F.collect_set("reg").alias("regs"))
    rows = visited.groupBy("cid", "fm").agg(F.max("sim").alias("sim"), F.count("*").alias("visits"), F.array_sort(F.collect_set("anchor")).alias("anchors"), F.min("turn").alias("turn"))
    rows = rows.join(fms, "fm").join(docs, "fm", "left").join(mastered, "fm", "left").join(regs, "fm", "left").join(conditions.select("cid", "market", "shape"), "cid")
    market = F.coalesce(F.exists("regs", lambda r: domain.holds_any(r, domain.market_words(F.col("market")))), F.lit(False))
    shape = domain.holds_any(F.col("title"), shape_tokens(F.col("shape")))
    boost = F.when(market, BOOST["market"]).otherwise(0.0) + F.when(shape, BOOST["shape"]).otherwise(0.0)
    boost = boost if boost_once else boost * F.col("visits")
    boost = boost if extra is None else boost + extra
    found = domain.confidence(F.col("sim"), F.coalesce("docs", F.lit(0)), F.col("severity"), F.coalesce("mastered", F.lit(False)), boost)
    steps = (lambda a: hop(a, F.lit("OCCURRED_IN"), F.col("fm"))) if rel == "OCCURRED_IN" else (lambda a: hop(a, F.lit(rel), F.col("fm")))
    rows = rows.select("cid", "fm", "severity", "visits", market.alias("regulated"), found.alias("f"), F.transform("anchors", steps).alias("trace"), "turn", F.col("sim").alias("likeness"))
    return rows.select("cid", "fm", "severity", "visits", "regulated", "trace", "turn", "likeness", "f.*")


def labels_behind(found: DataFrame, visited: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``cid, fm, evidence``: two documents of a failure mode, its first standard and action, and the labels of its anchors, in this order."""
    key, label = ["canvas_id", "fm"], nodes.select("canvas_id", F.col("id").alias("dst"), F.col("label").alias("name"))
    fms = nodes.where("type = 'fm'").select("canvas_id", F.col("id").alias("fm")).join(found.select("fm").distinct(), "fm", "left_semi")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    docs = evidence(nodes, edges).select("canvas_id", F.col("id").alias("fm"), "filename", "ord").join(fms, key, "left_semi").withColumn("n", place).where("n <= 2")
    docs = docs.groupBy("fm").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "filename"))), lambda d: d["filename"]).alias("docs"))
    behind = lambda rel, name: edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias("fm"), "dst", "ord").join(fms, key, "left_semi").join(label, ["canvas_id", "dst"]).groupBy("fm").agg(F.min_by("name", "ord").alias(name))
    origins = visited.join(nodes.select(F.col("id").alias("anchor"), F.col("label").alias("name")), "anchor").groupBy("cid", "fm")
    origins = origins.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "name"))), lambda o: o["name"]).alias("origins"))
    rows = found.select("cid", "fm").join(docs, "fm", "left").join(behind("REF_MASTER", "standard"), "fm", "left").join(behind("MITIGATED_BY", "action"), "fm", "left").join(origins, ["cid", "fm"], "left")
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("docs", none), F.array("standard", "action"), F.coalesce("origins", none))
    return rows.select("cid", "fm", F.array_distinct(F.array_compact(every)).alias("evidence"))


def occurrences(nodes: DataFrame, edges: DataFrame, first: int = 3) -> DataFrame:
    """``fm, trace, evidence``: of the first projects that had a failure mode, how it is reached, their labels and the first document of each."""
    struck = edges.where("rel = 'OCCURRED_IN'").select("canvas_id", "src", F.col("dst").alias("fm"), "ord")
    place = F.row_number().over(Window.partitionBy("canvas_id", "fm").orderBy("ord"))
    projects = nodes.where("type = 'proj'").select("canvas_id", F.col("id").alias("src"), F.col("label").alias("name"))
    rows = struck.withColumn("n", place).where(F.col("n") <= first).join(projects, ["canvas_id", "src"])
    docs = evidence(nodes, edges).select("canvas_id", F.col("id").alias("src"), "filename", "ord").join(rows.select("canvas_id", "src").distinct(), ["canvas_id", "src"], "left_semi")
    rows = rows.join(docs.groupBy("canvas_id", "src").agg(F.min_by("filename", "ord").alias("doc")), ["canvas_id", "src"], "left")
    each = F.array_sort(F.collect_list(F.struct("n", hop("src", F.lit("OCCURRED_IN"), "fm").alias("step"), F.array("name", "doc").alias("proof"))))
    rows = rows.groupBy("fm").agg(each.alias("o"))
    return rows.select("fm", F.transform("o", lambda x: x["step"]).alias("trace"), F.array_distinct(F.array_compact(F.flatten(F.transform("o", lambda x: x["proof"])))).alias("evidence"))


def cause_findings(found: DataFrame, active: DataFrame, nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str, float]], severity: Column) -> DataFrame:
    """``cid, anchor, category, severity, trace, evidence, turn, confidence``: causes that a condition's rules weigh, reached from one of its concerns.

    rules: (name, pattern on the cause's label, boost); active: (cid, rule).  The first cause that meets a rule's pattern is its anchor, reached from the
    first concern that it explains; a rule without such a cause or concern adds nothing, nor does one whose cause has been named by an earlier rule.
    What the cause leads back to, first the failure mode of the same theme, gives severity, standards and evidence.  Each canvas has a row for
    every rule at most before conditions come in.
    """
    key = ["canvas_id", "cause"]
    causes = nodes.where("type = 'cause'").select("canvas_id", F.col("id").alias("cause"), F.col("label").alias("name"), "ord", severity.alias("own_severity"))
    chosen = None
    for rank, (rule, pattern, boost) in enumerate(rules):
        one = causes.where(F.col("name").rlike(pattern)).groupBy("canvas_id").agg(F.min_by(F.struct("cause", "name", "own_severity"), "ord").alias("c"))
        one = one.select("canvas_id", "c.*", F.lit(rule).alias("rule"), F.lit(rank).alias("rank"), F.lit(pattern).alias("pattern"), F.lit(boost).alias("weight"))
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = settle(chosen)
    links = edges.where("rel = 'CAUSED_BY'").select("canvas_id", F.col("dst").alias("cause"), F.col("src").alias("fm"), "ord").join(F.broadcast(chosen.select(*key).distinct()), key, "left_semi")
    fms = nodes.where("type = 'fm'").select("canvas_id", F.col("id").alias("fm"), F.col("label").alias("fm_label"), severity.alias("fm_severity"))
    back = links.join(fms, ["canvas_id", "fm"]).join(F.broadcast(chosen.select(*key, "rule", "pattern")), key)
    theme = F.when(F.regexp_like("fm_label", "pattern") | F.col("fm_label").contains(F.split("pattern", r"\|")[0]), 0).otherwise(1)
    back = back.groupBy("canvas_id", "cause", "rule").agg(F.min_by(F.struct("fm", "fm_label", "fm_severity"), F.struct(theme, "ord")).alias("r"))
    standard = edges.where("rel = 'REF_MASTER'").select("canvas_id", F.col("src").alias("s")).distinct()
    proof = evidence(nodes, edges)
    ends = chosen.select("canvas_id", F.col("cause").alias("id")).unionByName(back.select("canvas_id", F.col("r.fm").alias("id"))).distinct()
    proof = proof.join(F.broadcast(ends), ["canvas_id", "id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("canvas_id", "id").orderBy("ord")))
    docs = proof.groupBy("canvas_id", "id").agg(F.count("*").alias("docs"), F.array_sort(F.collect_list(F.when(F.col("n") <= 2, F.struct("n", "filename")))).alias("files"))
    of = lambda name: docs.select("canvas_id", F.col("id").alias(name), F.col("docs").alias(f"{name}_docs"), F.transform("files", lambda f: f["filename"]).alias(f"{name}_files"))
    told = chosen.join(back.select("canvas_id", "cause", "rule", F.col("r.fm").alias("related"), F.col("r.fm_label").alias("related_label"), F.col("r.fm_severity").alias("related_severity")), [*key, "rule"], "left")
    told = told.join(of("cause"), key, "left").join(of("related"), ["canvas_id", "related"], "left")
    told = told.join(standard.withColumnRenamed("s", "cause").withColumn("m1", F.lit(True)), key, "left").join(standard.withColumnRenamed("s", "related").withColumn("m2", F.lit(True)), ["canvas_id", "related"], "left")
    reached = found.select("cid", "fm", "trace", "turn", "likeness").join(links.select("canvas_id", "cause", "fm"), "fm").join(F.broadcast(chosen.select(*key, "rule", "rank")), key).join(active, ["cid", "rule"])
    reached = reached.groupBy("cid", "canvas_id", "cause", "rule", "rank").agg(F.min_by(F.struct("fm", "trace", "likeness", "turn"), "turn").alias("s"))
    reached = first_per_key(reached, ["cid", "canvas_id", "cause"], "rank").select("cid", *key, "rule", "s.*")
    rows = reached.join(F.broadcast(told), [*key, "rule"])
    none = F.array().cast("array<string>")
    steps = F.concat(F.filter("trace", lambda t: ~t.contains("UNDER_REG")), F.array(hop("fm", F.lit("CAUSED_BY"), "cause"), F.when(F.col("related").isNotNull(), hop("related", F.lit("CAUSED_BY"), "cause"))))
    named = F.concat(F.coalesce("cause_files", none), F.slice(F.coalesce("related_files", none), 1, 1), F.array("related_label"))
    named = F.array_distinct(F.array_compact(named))
    s = F.coalesce("related_severity", "own_severity", F.lit(5))
    score = domain.confidence(F.col("likeness"), F.coalesce("cause_docs", F.lit(0)), s, F.coalesce("m1", "m2", F.lit(False)), F.col("weight"))["confidence"]
    return rows.select(
        "cid", F.col("cause").alias("anchor"), F.col("rule").alias("category"), s.alias("severity"), F.array_distinct(F.array_compact(steps)).alias("trace"),
        F.when(F.size(named) > 0, named).otherwise(F.array("name")).alias("evidence"), "turn", score.alias("confidence"),
    )


def checklist(found: DataFrame, causes: DataFrame | None = None, top: int = 8) -> DataFrame:
    """The most certain findings of each condition that have evidence and a trace, and how many there are.

    found: concerns with ``evidence``; causes: ``cause_findings``.  Of equally certain ones the graver come first, then failure modes in the order in which they
    were met, then causes.
    """
    kind = F.when(F.col("regulated"), "regulatory").otherwise("failure-mode")
    rows = found.select("cid", F.col("fm").alias("anchor"), kind.alias("category"), "severity", "trace", "evidence", "turn", "confidence", F.lit(0).alias("late"))
    if causes is not None:
        rows = rows.unionByName(causes.withColumn("late", F.lit(1)))
    rows = rows.where((F.size("evidence") > 0) & (F.size("trace") > 0))
    totals = rows.groupBy("cid").agg(F.count("*").alias("total"))
    order = Window.partitionBy("cid").orderBy(F.desc("confidence"), F.desc("severity"), "late", "turn", "anchor")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return rows.join(totals, "cid").drop("late", "turn")


def cause_concerns(conditions: DataFrame, nodes: DataFrame, edges: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """``cid, rule, cause, fm``: causes whose label meets the pattern of a rule that the condition's shape sets off, with the first failure mode of each.

    rules: name -> (pattern on the shape, pattern on the cause's label).
    """
    links = edges.where("rel = 'CAUSED_BY'").select("canvas_id", F.col("dst").alias("cause"), F.col("src").alias("fm"), F.col("ord").alias("link"))
    labels = nodes.where("type = 'cause'").select("canvas_id", F.col("id").alias("cause"), F.col("label").alias("name"))
    rows = None
    for rule, (shape, label) in rules.items():
        active = conditions.where(F.exists("shape", lambda s: s.rlike(shape))).select("cid")
        hits = labels.where(F.col("name").rlike(label)).join(links, ["canvas_id", "cause"])
        first = first_per_key(hits, ["canvas_id", "cause"], "link").select("cause", "fm")
        # conditions are a query set against all causes
        for block in in_blocks(active, "cid"):
            part = first.join(block, F.lit(True)).select("cid", F.lit(rule).alias("rule"), "cause", "fm")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def coverage(required: DataFrame, corpus: DataFrame) -> DataFrame:
    """``id, covered, unknown, missing``: required items (id, item) judged by how many of their tokens the texts (id, text) hold."""
    tokens = F.filter(F.split(F.lower("item"), r"\s+"), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]"))
    rows = required.withColumn("t", tokens).join(corpus, "id", "left").withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    ratio = F.when(F.size("t") > 0, F.size(F.filter("t", lambda t: F.col("text").contains(t))) / F.size("t")).otherwise(0.0)
    rows = rows.withColumn("r", ratio)
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("item"))))
    return rows.groupBy("id").agg(pick(F.col("r") >= 1).alias("covered"), pick((F.col("r") > 0) & (F.col("r") < 1)).alias("unknown"), pick(F.col("r") == 0).alias("missing"))


def worksheet(items: DataFrame, nodes: DataFrame, edges: DataFrame, severity: Column, occurrence: Column, detection: Column, causes: int = 3, actions: int = 3, top: int | None = 40) -> DataFrame:
    """Draft rows ``item, fm, cause, s, o, d, rpn, priority, action`` for items (canvas_id, id) and their parts.

    Automatic nodes count only where no others are; of equal failure mode and cause the highest risk stays.
    """
    parts = edges.where("rel = 'CONSISTS_OF'").select("canvas_id", F.col("src").alias("id"), "dst")
    targets = items.select("canvas_id", "id").unionByName(items.join(parts, ["canvas_id", "id"]).select("canvas_id", F.col("dst").alias("id"))).distinct()
    label = nodes.select("canvas_id", "id", F.col("label").alias("name"))

    def step(rel: str, source: str, target: str) -> DataFrame:
        rows = edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias(source), F.col("dst").alias(target), F.col("ord").alias(f"{target}_ord"))
        auto = F.col(target).startswith("AUTO_")
        some = F.max(~auto).over(Window.partitionBy("canvas_id", source))
        return rows.withColumn("_some", some).where(~auto | ~F.col("_some")).drop("_some")

    order = Window.partitionBy("canvas_id", "fm").orderBy("cause_ord")
    why = step("CAUSED_BY", "fm", "cause").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= causes).drop("_n")
    rows = targets.withColumnRenamed("id", "item").join(step("HAS_FAILURE", "item", "fm"), ["canvas_id", "item"]).join(why, ["canvas_id", "fm"], "left")
    todo = step("MITIGATED_BY", "fm", "action").join(label.withColumnRenamed("id", "action"), ["canvas_id", "action"])
    done = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("action_ord", "name"))), lambda x: x["name"]), 1, actions), ", ")
    rows = rows.join(todo.groupBy("canvas_id", "fm").agg(done.alias("action")), ["canvas_id", "fm"], "left")
    rows = rows.withColumns({"s": severity, "o": F.least(F.lit(10), occurrence), "d": detection}).withColumn("rpn", F.col("s") * F.col("o") * F.col("d"))
    best = first_per_key(rows, ["canvas_id", "fm", "cause"], F.desc("rpn"), F.desc("s"), "item")
    best = best.select("item", "fm", "cause", "s", "o", "d", "rpn", domain.priority(F.col("rpn")).alias("priority"), F.coalesce("action", F.lit("")).alias("action"))
    return best if top is None else best.orderBy(F.desc("rpn"), F.desc("s"), "fm", "cause").limit(top)


def expansion_gaps(nodes: DataFrame, edges: DataFrame, material: Column, warn: int = 80, risk: int = 150) -> DataFrame:
    """``item, one, other, gap, level, confidence``: parts of one item whose materials expand unlike, for all items at once.

    Parts are first put together by material, so that an item with many parts of few materials makes few pairs.
    """
    value = nodes.where("type = 'item'").select("canvas_id", F.col("id").alias("dst"), domain.expansion(material).alias("cte")).where("cte is not null")
    parts = edges.where("rel = 'CONSISTS_OF'").select("canvas_id", F.col("src").alias("item"), "dst").join(value, ["canvas_id", "dst"])
    kinds = parts.groupBy("canvas_id", "item", "cte").agg(F.min("dst").alias("part"), F.count("*").alias("n"))
    a, b = kinds.alias("a"), kinds.alias("b")
    pair = (F.col("a.canvas_id") == F.col("b.canvas_id")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.cte") + warn <= F.col("b.cte"))
    gap = F.col("b.cte") - F.col("a.cte")
    found = a.join(b, pair).select(F.col("a.item").alias("item"), F.col("a.part").alias("one"), F.col("b.part").alias("other"), gap.alias("gap"), (F.col("a.n") * F.col("b.n")).alias("pairs"))
    level = F.when(F.col("gap") >= risk, "risk").otherwise("warn")
    return found.withColumns({"level": level, "confidence": F.least(F.greatest(half_up(50 + F.col("gap") / 4), F.lit(50)), F.lit(95))})


def similar_with_history(edges: DataFrame, wanted: Column, have: Column) -> DataFrame:
    """``id, other, fm, weight``: projects without a wanted failure that are SIMILAR (either way) to one that had it.

    wanted: condition on the failure mode ``fm``; have: condition on the project ``id``.
    """
    struck = edges.where("rel = 'OCCURRED_IN'").select("canvas_id", F.col("src").alias("id"), F.col("dst").alias("fm"), "ord").where(wanted)
    first = first_per_key(struck, ["canvas_id", "id"], "ord").select("canvas_id", F.col("id").alias("other"), "fm")
    near = both_ways(edges.where("rel = 'SIMILAR'")).select("canvas_id", "id", "other", F.coalesce("weight", F.lit(0.5)).alias("weight")).where(have)
    return near.join(struck.select("canvas_id", "id"), ["canvas_id", "id"], "left_anti").join(first, ["canvas_id", "other"]).select("id", "other", "fm", "weight")
