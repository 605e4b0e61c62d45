"""Queries on smaller operators: rankings, unions, rule answers and drawing checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import is_subset, nospace
from kgspark.operators import graph as op
from kgspark.sources import documents as src
from kgspark.sources.tables import graph, table
from kgspark.sources.tables import edges as all_edges
from kgspark.sources.tables import nodes as all_nodes

from .graph import g
from .ingest import _DRAWN, drawings
from .registry import query

c = F.col


@query("select p_partkey, len(list_intersect(a, b)) as shared, list_has_all(b, a) as subset from (select p_partkey, list_distinct(string_split(p_name, ' ')) as a, list_distinct([split_part(p_name, ' ', 1), p_type, 'ring']) as b from part)")
def u4_subset_and_overlap(spark, d) -> DataFrame:
    """Subset test and size of the intersection of token sets."""
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.array(F.split("p_name", " ")[0], c("p_type"), F.lit("ring")))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), is_subset(a, b).alias("subset"))


@query(g(" select id, type in ('item', 'fm', 'cause', 'action') as allowed from nodes"))
def u6_allowed_types(spark, d) -> DataFrame:
    return all_nodes(spark, d).select("id", c("type").isin("item", "fm", "cause", "action").alias("allowed"))


@query(g(", s as (select src as a, dst as b from edges where rel = 'SIMILAR' and weight >= 0.5), l as (select src as a, dst as b from edges where rel = 'SIMILAR' and ord % 2 = 0) select a, b from s where (a, b) not in (select a, b from l)"))
def u3_pairs_difference(spark, d) -> DataFrame:
    """Pairs of one search that another has not."""
    e = all_edges(spark, d).where("rel = 'SIMILAR'").select(c("src").alias("a"), c("dst").alias("b"), "weight", "ord")
    return e.where("weight >= 0.5").select("a", "b").join(e.where("ord % 2 = 0").select("a", "b"), ["a", "b"], "left_anti")


@query(g(" select dst as fm, max_by(src, (weight_key, -ord)) as best from (select *, length(src) as weight_key from edges where rel = 'OCCURRED_IN') group by dst"))
def k6_best_of_group(spark, d) -> DataFrame:
    rows = all_edges(spark, d).where("rel = 'OCCURRED_IN'")
    return rows.groupBy(c("dst").alias("fm")).agg(F.max_by("src", F.struct(F.length("src").alias("n"), (-c("ord")).alias("o"))).alias("best"))


@query(g(", h as (select src as proj, dst as fm, row_number() over (partition by src order by case when dst like 'F%1' then 0 else 1 end, ord) as place from edges where rel = 'OCCURRED_IN') select proj, fm, place from h where place <= 3"))
def k7_capped_history(spark, d) -> DataFrame:
    """Three failure modes of each project, the most urgent first."""
    rows = all_edges(spark, d).where("rel = 'OCCURRED_IN'").select(c("src").alias("proj"), c("dst").alias("fm"), "ord")
    place = Window.partitionBy("proj").orderBy(F.when(c("fm").like("F%1"), 0).otherwise(1), "ord")
    return rows.withColumn("place", F.row_number().over(place)).where("place <= 3").select("proj", "fm", "place")


@query(
    g(""", x as (select r.label as region, e.src as fm, count(*) over (partition by r.label) as n, row_number() over (partition by r.label order by e.ord) as place from edges e join nodes r on r.id = e.dst where e.rel = 'UNDER_REG')
    select region, region || ': ' || max(n) || ' failure modes, first ' || string_agg(fm, ', ' order by place) filter (where place <= 3) as answer from x group by region""")
)
def t10_region_answers(spark, d) -> DataFrame:
    """A sentence per region on the failure modes under its rules."""
    gr = graph(spark, d)
    names = gr.nodes.where("type = 'reg'").select("canvas_id", c("id").alias("dst"), c("label").alias("region"))
    rows = gr.edges.where("rel = 'UNDER_REG'").join(names, ["canvas_id", "dst"]).groupBy("region").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "src"))).alias("f"))
    first = F.array_join(F.transform(F.slice("f", 1, 3), lambda x: x["src"]), ", ")
    return rows.select("region", F.concat(c("region"), F.lit(": "), c("n").cast("string"), F.lit(" failure modes, first "), first).alias("answer"))


@query(g(", dg as (select dst as id, count(*) as shared from edges where rel = 'OCCURRED_IN' group by dst) select e.src as proj, e.dst as fm, shared, row_number() over (partition by e.src order by shared desc, e.ord) as place from edges e join dg on dg.id = e.dst where rel = 'OCCURRED_IN'"))
def k12_stable_rerank(spark, d) -> DataFrame:
    """Neighbours ordered anew by a count, ties in the order of insertion."""
    e = all_edges(spark, d).where("rel = 'OCCURRED_IN'").select(c("src").alias("proj"), c("dst").alias("fm"), "ord")
    shared = e.groupBy("fm").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("proj").orderBy(F.desc("shared"), "ord"))
    return e.join(shared, "fm").select("proj", "fm", "shared", place.alias("place"))


@query("select conv_id, coalesce(min_by(text, turn) filter (where contains(lower(text), 'the')), min_by(text, turn) filter (where role = 'user'), min_by(text, turn)) as reference from conversations group by conv_id")
def t11_resolved_reference(spark, d) -> DataFrame:
    """What a conversation is about: the first turn that names it, else the user's first, else the first."""
    first = lambda cond: F.min_by(F.when(cond, c("text")), F.when(cond, c("turn")))
    ways = [first(F.lower("text").contains("the")), first(c("role") == "user"), first(F.lit(True))]
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(*ways).alias("reference"))


@query(_DRAWN + " select file, count(*) as texts, bool_or(part % 5 = 0) as has_five, case when count(*) < 3 then 'few texts' when not bool_or(part % 5 = 0) then 'no vent' else 'fine' end as verdict from p group by file")
def g20_drawing_rules(spark, d) -> DataFrame:
    """Rules on the texts of each drawing (multiples of five stand for vents)."""
    texts = src.drawing_entities(drawings(spark, d)).where("kind = 'TEXT'")
    vent = F.substring("value", 2, 20).cast("long") % 5 == 0
    rows = texts.groupBy("file").agg(F.count("*").alias("texts"), F.bool_or(vent).alias("has_five"))
    return rows.withColumn("verdict", F.when(c("texts") < 3, "few texts").when(~c("has_five"), "no vent").otherwise("fine"))


@query("select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) as host, contains(regexp_replace(lower(html), '\\s+', '', 'g'), 'nav') as has_nav from pages")
def s11_page_blocks(spark, d) -> DataFrame:
    """Host of a page, and whether its source holds a navigation block, blanks not counted."""
    return table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), nospace(c("html")).contains("nav").alias("has_nav"))
