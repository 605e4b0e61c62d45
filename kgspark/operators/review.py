"""What stands behind a concern: causes, standards, actions and rules in order, audits of standards, and the context of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import ellipsis

from .graph import evidence, first_per_key

#: Words that say nothing about an item.
STOP = ("이상", "이하", "이내")


def by_shared_evidence(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``place`` and ``shared`` of steps (canvas_id, anchor, id, i): those that share most documents with their anchor first, else by ``i``."""
    proof = evidence(nodes, edges).select("canvas_id", "id", "doc").distinct()
    own = proof.select("canvas_id", F.col("id").alias("anchor"), "doc")
    pairs = steps.select("canvas_id", "anchor", "id").distinct()
    shared = pairs.join(proof, ["canvas_id", "id"]).join(own, ["canvas_id", "anchor", "doc"], "left_semi").groupBy("canvas_id", "anchor", "id").agg(F.count("*").alias("shared"))
    rows = steps.join(shared, ["canvas_id", "anchor", "id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("canvas_id", "anchor").orderBy(F.desc("shared"), "i")))


def expansions(nodes: DataFrame, edges: DataFrame, shown: int = 3) -> DataFrame:
    """``canvas_id, fm, causes, master, action, regs, docs``: what every failure mode leads to.

    causes: labels of the first ones, by shared evidence.  master, action: the best one of the failure mode itself and of its
    causes, by shared evidence.  regs: labels of its rules in order.  docs: names of its first two documents and of the first cause's first.
    """
    key = ["canvas_id", "fm"]
    label = nodes.select("canvas_id", "id", "label")
    fms = nodes.where("type = 'fm'").select("canvas_id", F.col("id").alias("fm"))

    def out(rel: str) -> DataFrame:
        return edges.where(F.col("rel") == rel).select("canvas_id", F.col("src").alias("anchor"), F.col("dst").alias("id"), F.col("ord").alias("i"))

    of_fm = lambda rel: out(rel).join(fms.withColumnRenamed("fm", "anchor"), ["canvas_id", "anchor"], "left_semi")
    causes = by_shared_evidence(of_fm("CAUSED_BY"), nodes, edges)

    def best(rel: str, name: str) -> DataFrame:
        over = causes.select("canvas_id", F.col("anchor").alias("fm"), F.col("id").alias("anchor"), "place").join(out(rel), ["canvas_id", "anchor"])
        steps = of_fm(rel).select("canvas_id", "anchor", "id", F.struct(F.lit(0).alias("p"), "i").alias("i")).unionByName(
            over.select("canvas_id", F.col("fm").alias("anchor"), "id", F.struct(F.col("place").alias("p"), "i").alias("i"))
        )
        first = by_shared_evidence(steps, nodes, edges).where("place = 1").join(label, ["canvas_id", "id"])
        return first.select("canvas_id", F.col("anchor").alias("fm"), F.col("label").alias(name))

    listed = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("label").alias("l")))), lambda x: x["l"])
    why = causes.where(F.col("place") <= shown).join(label, ["canvas_id", "id"]).groupBy("canvas_id", F.col("anchor").alias("fm")).agg(listed("place").alias("causes"))
    regs = of_fm("UNDER_REG").join(label, ["canvas_id", "id"]).groupBy("canvas_id", F.col("anchor").alias("fm")).agg(listed("i").alias("regs"))
    files = evidence(nodes, edges).withColumn("n", F.row_number().over(Window.partitionBy("canvas_id", "id").orderBy("ord", "doc")))
    own = files.join(fms.withColumnRenamed("fm", "id"), ["canvas_id", "id"], "left_semi").where("n <= 2").select("canvas_id", F.col("id").alias("fm"), "n", "filename")
    first = causes.where("place = 1").select("canvas_id", F.col("anchor").alias("fm"), "id").join(files.where("n = 1"), ["canvas_id", "id"]).select("canvas_id", "fm", F.lit(3).alias("n"), "filename")
    docs = own.unionByName(first).groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "filename"))), lambda x: x["filename"])).alias("docs"))
    rows = fms
    for part in (why, best("REF_MASTER", "master"), best("MITIGATED_BY", "action"), regs, docs):
        rows = rows.join(part, key, "left")
    none = F.array().cast("array<string>")
    return rows.select(*key, *(F.coalesce(c, none).alias(c) for c in ("causes", "regs", "docs")), "master", "action")


def required_items(masters: DataFrame, pattern: str = "^항목[0-9]*$") -> DataFrame:
    """``canvas_id, master, item, ord``: what a standard asks for, from the parts of its item properties, the first of equal ones."""
    props = masters.select("canvas_id", F.col("id").alias("master"), F.posexplode("props").alias("i", "p")).where(F.col("p.k").rlike(pattern))
    parts = props.select("canvas_id", "master", "i", F.posexplode(F.split("p.v", "[·,]")).alias("j", "item")).select("canvas_id", "master", F.trim("item").alias("item"), F.struct("i", "j").alias("ord"))
    return first_per_key(parts.where("item <> ''"), ["canvas_id", "master", "item"], "ord")


def item_tokens(item: Column) -> Column:
    """Words of an item that say something, in lower case; the whole item where there are none and it has three characters or more."""
    whole = F.lower(F.trim(item))
    words = F.filter(F.split(whole, r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP) & ~t.rlike("^[0-9]"))
    alone = F.when((F.length(whole) >= 3) & ~whole.isin(*STOP), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) > 0, words).otherwise(alone)


def master_audit(concerns: DataFrame, masters: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``canvas_id, master, label, required, covered, unknown, missing``: what of each standard the texts of its concerns deal with.

    concerns: (canvas_id, master, text); synonyms: (base, word).  An item is covered if every word of it, or another word of its
    group, stands in some text, unknown if a part does.  Texts meet words one by one, so they are never put together.
    """
    items = required_items(masters).withColumn("tokens", item_tokens(F.col("item")))
    groups = synonyms.select("base", F.lower("word").alias("w")).unionByName(synonyms.select("base", F.lower("base").alias("w"))).distinct()
    first = groups.groupBy("w").agg(F.min("base").alias("base")).withColumnRenamed("w", "token")
    tokens = items.select("canvas_id", "master", F.explode("tokens").alias("token")).distinct()
    other = tokens.join(first, "token").join(groups, "base").select("canvas_id", "master", "token", "w")
    ways = tokens.select("canvas_id", "master", "token", F.col("token").alias("w")).unionByName(other).distinct()
    texts = concerns.select("canvas_id", "master", F.lower("text").alias("text"))
    held = texts.join(ways, ["canvas_id", "master"]).where(F.col("text").contains(F.col("w"))).select("canvas_id", "master", "token").distinct().withColumn("held", F.lit(1))
    each = items.select("canvas_id", "master", "item", "ord", F.explode_outer("tokens").alias("token")).join(held, ["canvas_id", "master", "token"], "left")
    # a word that stands twice in an item counts twice
    share = F.when(F.count("token") > 0, F.count("held") / F.count("token")).otherwise(0.0)
    rated = each.groupBy("canvas_id", "master", "item").agg(share.alias("r"), F.min("ord").alias("ord"))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "item")))), lambda x: x["item"])
    r = F.col("r")
    audits = rated.groupBy("canvas_id", "master").agg(pick(F.lit(True)).alias("required"), pick(r >= 1).alias("covered"), pick((r > 0) & (r < 1)).alias("unknown"), pick(r == 0).alias("missing"))
    reached = concerns.select("canvas_id", "master").distinct()
    return audits.join(reached, ["canvas_id", "master"], "left_semi").join(masters.select("canvas_id", F.col("id").alias("master"), "label"), ["canvas_id", "master"])


def review_contexts(checks: DataFrame, audits: DataFrame, contradictions: DataFrame, checks_shown: int = 8, contradictions_shown: int = 5, cut: int = 120) -> DataFrame:
    """``cid, checks, audits, contradictions``: the lines that a review of a condition is given.

    checks: (cid, no, title, desc, confidence), of which the first go in, their texts cut; audits: (cid, label, required, covered, missing);
    contradictions: (title, ord), the same for all.
    """
    # fixed values: the wording of the lines
    line = F.concat(F.col("no").cast("string"), F.lit(". "), "title", F.lit(" — "), ellipsis(F.col("desc"), cut), F.lit(" ("), F.col("confidence").cast("string"), F.lit("%)"))
    top = first_rows(checks, ["cid"], "no", checks_shown).groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("l")))), lambda x: x["l"]).alias("checks"))
    more = F.when(F.size("missing") > 3, " 외").otherwise("")
    lacking = F.when(F.size("missing") > 0, F.concat(F.lit(" — 누락: "), F.array_join(F.slice("missing", 1, 3), ", "), more)).otherwise("")
    count = lambda name: F.size(name).cast("string")
    audit = F.concat("label", F.lit(": 필수 "), count("required"), F.lit("항목 중 "), count("covered"), F.lit(" 커버"), lacking)
    lines = audits.groupBy("cid").agg(F.array_sort(F.collect_list(audit)).alias("audits"))
    # one row of at most as many titles as are shown
    titles = contradictions.orderBy("ord").limit(contradictions_shown).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("contradictions"))
    none = F.array().cast("array<string>")
    rows = top.join(lines, "cid", "full").join(F.broadcast(titles), F.lit(True), "left")
    return rows.select("cid", F.coalesce("checks", none).alias("checks"), F.coalesce("audits", none).alias("audits"), F.coalesce("contradictions", none).alias("contradictions"))


def first_rows(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
