"""What drawings say: labels, shape features, notes and parts lists out of their texts, and rules on them.

Texts are rows ``file, entity, x, y, value``; ``entity`` is their order in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import domain

from .graph import first_per_key
from .lineage import settle
from .shapes import most_alike

# Keys of shape features, headers of a parts list, and the words and limits of the rules.
FEATURES = ("하우징", "벤트 홀", "벤트", "실링", "개스킷 소재", "개스킷", "커넥터", "렌즈", "결로 방지", "드레인")
HEADERS = ("품번", "품명", "수량", "재질")
GAP, NEAR, GRADE = 80, 45, 66
HUMID = "아시아|동남아|중동|중국"
_NUMBER = r"^[0-9]+[.)]\s*"


def keyed(texts: DataFrame) -> DataFrame:
    """``file, what, k, v``: "key: value" texts as labels and features, numbers before them taken off; the first of each key counts."""
    plain = F.regexp_replace(F.trim("value"), _NUMBER, "")
    pattern = "^([^:：]{1,20})[:：]\\s*(.+)$"
    rows = texts.select("file", "entity", F.trim(F.regexp_extract(plain, pattern, 1)).alias("k"), F.trim(F.regexp_extract(plain, pattern, 2)).alias("v")).where("v <> '' and k <> 'NOTE'")
    what = F.when(F.col("k").isin(*FEATURES), "feature").otherwise("label")
    return first_per_key(rows, ["file", "k"], "entity").select("file", what.alias("what"), "k", "v")


def notes(texts: DataFrame) -> DataFrame:
    """``file, entity, note``: numbered texts that are no "key: value" pairs."""
    plain = F.regexp_replace(F.trim("value"), _NUMBER, "")
    return texts.where(F.trim("value").rlike(r"^[0-9]+[.)]\s+") & ~plain.rlike("^[^:：]{1,20}[:：]\\s*.+$")).select("file", "entity", plain.alias("note"))


def parts_lists(texts: DataFrame, line: float = 2.0) -> DataFrame:
    """``file, row, no, name, qty, material``: the parts list of each drawing.

    The header gives the columns and the area.  Texts below it make a row with the first one from above that they are within ``line`` of;
    each stands in the column whose header is nearest.  The list ends at the first row without a number.  The rows of one drawing are
    put together in one array.
    """
    named = texts.where(F.col("value").isin(*HEADERS)).select("file", "entity", "x", "y", F.col("value").alias("name"))
    top = first_per_key(named.where(F.col("name") == HEADERS[0]), ["file"], "entity").select("file", F.col("y").alias("top"))
    heads = first_per_key(named.join(top, "file").where(F.abs(F.col("y") - F.col("top")) <= line), ["file", "name"], "entity")
    at = [F.max(F.when(F.col("name") == h, F.col("x"))).alias(f"c{i}") for i, h in enumerate(HEADERS)]
    heads = heads.groupBy("file", "top").agg(*at).where(" and ".join(f"c{i} is not null" for i in range(len(HEADERS))))
    cells = texts.join(heads, "file").where((F.col("x") >= F.col("c0") - 4) & (F.col("x") <= F.col("c3") + 60) & (F.col("y") < F.col("top") - line))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("x") - F.col(f"c{i}")).alias("d"), F.lit(i).alias("i")) for i in range(len(HEADERS)))))["i"]
    cells = cells.select("file", F.struct((-F.col("y")).alias("d"), "x", "entity", nearest.alias("col"), "value").alias("t"))
    whole = cells.groupBy("file").agg(F.array_sort(F.collect_list("t")).alias("t"))
    begin = F.struct(F.lit(None).cast("double").alias("d"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, t: Column) -> Column:
        new = s["d"].isNull() | (t["d"] - s["d"] > line)
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        return F.struct(F.when(new, t["d"]).otherwise(s["d"]).alias("d"), row.alias("row"), F.array_append(s["rows"], row).alias("rows"))

    placed = whole.withColumn("rows", F.aggregate("t", begin, step, lambda s: s["rows"])).select("file", F.explode(F.arrays_zip("t", "rows")).alias("z"))
    first = first_per_key(placed.select("file", F.col("z.rows").alias("row"), F.col("z.t.col").alias("col"), "z.t.x", "z.t.entity", "z.t.value"), ["file", "row", "col"], "x", "entity")
    value = [F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in enumerate(("no", "name", "qty", "material"))]
    rows = first.groupBy("file", "row").agg(*value)
    ended = F.min(F.when(~F.coalesce("no", F.lit("")).rlike("^[0-9]+$"), F.col("row"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("_end", ended).where("_end is null or row < _end")
    return rows.select("file", "row", "no", *(F.coalesce(n, F.lit("")).alias(n) for n in ("name", "qty", "material")))


def drawing_graph(pairs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties (file, name, k, v) of the objects that drawings name, and edges (file, src, rel, dst) from assemblies to the parts of their lists.

    pairs: from ``keyed``; lists: from ``parts_lists``.  Names are to be resolved to ids afterwards.
    """
    one = lambda k: F.max(F.when((F.col("what") == "label") & (F.col("k") == k), F.col("v")))
    heads = pairs.groupBy("file").agg(one("부품명").alias("item"), one("프로젝트").alias("proj"))
    rows = pairs.join(heads, "file")
    of_item = rows.where("what = 'label' and k in ('소재', '도번') and item is not null").select("file", F.col("item").alias("name"), "k", "v")
    of_proj = rows.where("(what = 'feature' or k in ('차종', '시장')) and proj is not null")
    of_proj = of_proj.select("file", F.col("proj").alias("name"), F.when(F.col("what") == "feature", F.concat(F.lit("형상."), "k")).otherwise(F.col("k")).alias("k"), "v")
    made_of = lists.where("name <> '' and material not in ('', '-')").select("file", "name", F.lit("재질").alias("k"), F.col("material").alias("v"))
    links = lists.where("name <> ''").join(heads.where("item is not null"), "file").select("file", F.col("item").alias("src"), F.lit("CONSISTS_OF").alias("rel"), F.col("name").alias("dst")).distinct()
    return of_item.unionByName(of_proj).unionByName(made_of.distinct()), links


def risks(texts: DataFrame, pairs: DataFrame, markets: DataFrame) -> DataFrame:
    """``file, rule, level, detail``: weak points of each drawing; pairs from ``keyed``, markets (file, market).

    expansion: housing and gasket expand unlike.  vent-heat: a vent stands near the light source.  grade: the connector's grade in a humid
    market.  vents: a closed housing with at most one vent.
    """
    get = lambda what, k: F.max(F.when((F.col("what") == what) & (F.col("k") == k), F.col("v")))
    said = pairs.groupBy("file").agg(
        get("label", "소재").alias("material"), get("feature", "개스킷 소재").alias("gasket"), get("feature", "커넥터").alias("connector"), get("feature", "하우징").alias("housing"), get("feature", "벤트 홀").alias("vent")
    )
    rows = said.join(markets, "file", "left").withColumns({"a": domain.expansion(F.col("material")), "b": domain.expansion(F.col("gasket")), "n": F.coalesce(domain.vent(F.col("vent"))["count"], F.lit(0))})
    found = lambda df, rule, level, detail: df.select("file", F.lit(rule).alias("rule"), (level if isinstance(level, Column) else F.lit(level)).alias("level"), detail.alias("detail"))
    gap = F.abs(F.col("a") - F.col("b"))
    expand = found(rows.where(gap >= GAP), "expansion", "주의", F.format_string("%d: %d, %d", gap, "a", "b"))
    grade = F.regexp_extract("connector", "[0-9]+", 0).try_cast("int")
    humid = rows.where(F.col("market").rlike(HUMID) & grade.isNotNull())
    graded = found(humid, "grade", F.when(grade < GRADE, "높음").otherwise("주의"), F.concat_ws(", ", "connector", "market"))
    closed = found(rows.where(F.col("housing").contains("밀폐") & (F.col("n") <= 1)), "vents", "높음", F.concat_ws(", ", "housing", F.col("n").cast("string")))
    led = first_per_key(texts.where(F.col("value").rlike("(?i)^LED")), ["file"], "entity").select("file", F.col("x").alias("lx"), F.col("y").alias("ly"))
    vents = texts.where(F.col("value").rlike("(?i)VENT")).join(led, "file").where(F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")) < NEAR)
    near = vents.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity", "value"))), lambda t: t["value"]), "·").alias("names"))
    return expand.unionByName(found(near, "vent-heat", "주의", F.col("names"))).unionByName(graded).unionByName(closed)


def similar_projects(drawn: DataFrame, projects: DataFrame, top: int = 4) -> DataFrame:
    """``id, other, score, place``: the projects (id, features, ord) whose shape is most like that of each drawing (id, features).

    The drawings are a query set against all projects; projects of one shape are compared once.  The result is settled, as readers use it more than once.
    """
    one = lambda rows: rows.withColumn("kind", F.lit(""))
    return settle(most_alike(one(drawn), one(projects), top).select("id", "other", "score", "place"))


def with_matches(found: DataFrame, projects: DataFrame) -> DataFrame:
    """``found`` (id, other, ...) with ``matched``, the features in which the two projects (id, features) agree."""
    own = projects.select("id", F.col("features").alias("_f"))
    like = projects.select(F.col("id").alias("other"), F.col("features").alias("_h"))
    return found.join(own, "id").join(like, "other").withColumn("matched", domain.matched_features("_f", "_h")).drop("_f", "_h")


def similar_edges(found: DataFrame, least: float = 0.3) -> DataFrame:
    """``src, rel, dst, weight``: links to the similar projects above ``least``, to be merged into the graph."""
    return found.where(F.col("score") > least).select(F.col("id").alias("src"), F.lit("SIMILAR").alias("rel"), F.col("other").alias("dst"), F.col("score").alias("weight"))


def histories(projects: DataFrame, nodes: DataFrame, edges: DataFrame, urgent: Column, shown: int = 3) -> DataFrame:
    """``id, fms``: the failure modes that occurred in projects (id): regular before automatic ones, then those whose ``label`` is urgent, then in order."""
    fms = nodes.where("type = 'fm'").select("canvas_id", F.col("id").alias("fm"), F.when(urgent, 0).otherwise(1).alias("calm"))
    rows = edges.where("rel = 'OCCURRED_IN'").select("canvas_id", F.col("src").alias("id"), F.col("dst").alias("fm"), "ord").join(projects.select("id").distinct(), "id", "left_semi").join(fms, ["canvas_id", "fm"])
    rank = F.struct(F.when(F.col("fm").startswith("AUTO_"), 1).otherwise(0).alias("auto"), "calm", "ord")
    rows = rows.withColumn("r", rank).groupBy("id", "fm").agg(F.min("r").alias("r"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("r"))).where(F.col("n") <= shown)
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "fm"))), lambda x: x["fm"]).alias("fms"))
