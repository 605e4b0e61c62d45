"""Queries on graph audits and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import quality as q
from kgspark.operators.lineage import settle
from kgspark.sources.tables import Graph, graph
from kgspark.sources.tables import nodes as all_nodes

from .graph import g
from .registry import ORACLES, QUERIES, query


def with_automatic(spark, d) -> Graph:
    """The graph with automatically created parts: every twentieth spelled in capitals, others with one word more."""
    gr = graph(spark, d)
    part = gr.nodes.where("id like 'IP%' and (ord % 20 = 1 or ord % 20 = 3)")
    label = F.when(F.col("ord") % 20 == 1, F.upper(F.replace("label", F.lit(" "), F.lit("-")))).otherwise(F.concat("label", F.lit(" extra")))
    auto = part.withColumns({"id": F.concat(F.lit("AUTO_"), "id"), "label": label, "ord": F.col("ord") + 5 * 10**12})
    link = gr.edges.where("rel = 'EVIDENCED_BY'").join(part.select("canvas_id", F.col("id").alias("src")), ["canvas_id", "src"], "left_semi")
    link = link.withColumns({"src": F.concat(F.lit("AUTO_"), "src"), "ord": F.col("ord") + 5 * 10**12})
    return Graph(gr.nodes.unionByName(auto), gr.edges.unionByName(link.select(*gr.edges.columns)))


_AUTO = """, part as (select * from nodes where id like 'IP%' and (ord % 20 = 1 or ord % 20 = 3)),
 n2 as (select canvas_id, id, type, label, ord from nodes union all select canvas_id, 'AUTO_' || id, type, case when ord % 20 = 1 then upper(replace(label, ' ', '-')) else label || ' extra' end, ord + 5000000000000 from part),
 e2 as (select src, rel, dst from edges union all select 'AUTO_' || src, rel, dst from edges where rel = 'EVIDENCED_BY' and src in (select id from part)),
 proven as (select e.src as id, count(*) as docs from e2 e join nodes n on n.id = e.dst and n.type = 'doc' where e.rel = 'EVIDENCED_BY' group by e.src),
 folded as (select *, regexp_replace(lower(trim(label)), '[\\s·\\-_/()]', '', 'g') as fold, list_filter(regexp_split_to_array(lower(label), '[\\s·\\-_/()]+'), lambda t: length(t) >= 2) as tokens from n2 where type <> 'doc')"""


@query(
    g(_AUTO + """, found as (select a.id, r.id as r_id, r.ord as r_ord, case when a.fold = r.fold then 92 else 45 end as score from folded a join folded r on a.type = r.type and r.id not like 'AUTO\\_%' escape '\\'
      where a.id like 'AUTO\\_%' escape '\\' and a.id in (select id from proven) and (a.fold = r.fold or list_has_all(a.tokens, r.tokens) or list_has_all(r.tokens, a.tokens)))
    select 'main' as canvas_id, 'dup-candidate' as kind, id, min_by(r_id, (-score, r_ord)) as other, max(score) as confidence from found group by id""")
)
def q1_auto_duplicates(spark, d) -> DataFrame:
    gr = with_automatic(spark, d)
    return q.auto_duplicates(gr.nodes, gr.edges)


@query(
    g(""", f as (select id, type, regexp_replace(lower(trim(label)), '[\\s·\\-_/()]', '', 'g') as fold from nodes where type <> 'doc'), deg as (select i as id, count(*) as n from (select src as i from edges union all select dst from edges) group by i),
    won as (select f.*, first_value(f.id) over (partition by type, fold order by coalesce(n, 0) desc, length(f.id), f.id) as winner from f left join deg on deg.id = f.id where fold <> '')
    select 'main' as canvas_id, 'dup-candidate' as kind, id, winner as other, 88 as confidence from won where id <> winner and id in (select src from edges where rel = 'EVIDENCED_BY')""")
)
def q2_label_duplicates(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return q.label_duplicates(gr.nodes, gr.edges)


@query(g(_AUTO + " select 'main' as canvas_id, 'orphan' as kind, id, cast(null as varchar) as other, 55 as confidence from n2 where type <> 'doc' and id in (select id from proven) and id not in (select src from e2 where rel <> 'EVIDENCED_BY' union all select dst from e2 where rel <> 'EVIDENCED_BY')"))
def q4_orphans(spark, d) -> DataFrame:
    gr = with_automatic(spark, d)
    return q.orphans(gr.nodes, gr.edges)


@query(g(" select 'main' as canvas_id, 'no-evidence' as kind, id, cast(null as varchar) as other, 70 as confidence from nodes where type <> 'doc' and id not in (select src from edges where rel = 'EVIDENCED_BY')"))
def q5_without_evidence(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return q.without_evidence(gr.nodes, gr.edges)


@query(
    g(""", more as (select src, rel, dst from edges union all select fm, 'EVIDENCED_BY', 'D' || customer % (select count(*) from documents) from bad union all select 'C4', 'REF_MASTER', 'R1'),
    docs as (select src as id, count(*) as docs from more where rel = 'EVIDENCED_BY' group by src),
    sev as (select id, 10 - cast(substr(id, 4, 1) as int) as s from nodes where type = 'fm')
    select 'main' as canvas_id, 'master-missing' as kind, id, cast(null as varchar) as other, cast(floor(least(0.5::double * (s / 10.0::double) + 0.3::double * least(docs / 10.0::double, 1.0) + 0.1::double, 1.0) * 100 + 0.5) as int) as confidence
    from sev join docs using (id) where s >= 6 and id not in (select e.src from more e join more m on m.src = e.dst and m.rel = 'REF_MASTER' where e.rel = 'CAUSED_BY') and id in (select src from more where rel = 'CAUSED_BY')""")
)
def q6_master_gaps(spark, d) -> DataFrame:
    """Failure modes get documents from the projects they occurred in; one cause has a standard."""
    from kgspark.sources.tables import failures, table

    gr = graph(spark, d)
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    docs = failures(spark, d).join(F.broadcast(n), F.lit(True)).select(F.col("fm").alias("src"), F.lit("EVIDENCED_BY").alias("rel"), F.concat(F.lit("D"), F.col("customer") % F.col("n")).alias("dst"))
    more = docs.unionByName(spark.createDataFrame([("C4", "REF_MASTER", "R1")], "src string, rel string, dst string"))
    more = more.select(F.lit("main").alias("canvas_id"), "src", "rel", "dst", F.lit(None).cast("double").alias("weight"), F.lit(0).cast("long").alias("ord"))
    severity = F.get(F.filter("props", lambda p: p["k"] == "severity"), F.lit(0))["v"].cast("int")
    return q.master_gaps(gr.nodes, gr.edges.unionByName(more), severity)


RELATION_TYPES = [("main", "HAS_FAILURE", ["item"], ["fm"]), ("main", "UNDER_REG", ["proj"], ["reg"]), ("main", "SIMILAR", [], ["proj"]), ("main", "MITIGATED_BY", ["fm"], ["cause"])]


@query(g(" select 'main' as canvas_id, 'rel-domain' as kind, src as id, rel || '→' || dst as other, 85 as confidence from edges where rel in ('UNDER_REG', 'MITIGATED_BY')"))
def q7_relation_domains(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return q.relation_domains(gr.nodes, gr.edges, spark.createDataFrame(RELATION_TYPES, "canvas_id string, rel_id string, src_types array<string>, dst_types array<string>"))


SUBTYPES = [("main", "item", "ring", ["ring", "loop"], 0), ("main", "item", "blue", ["blue", "small"], 1), ("main", "item", "economy", ["ECONOMY"], 2), ("main", "reg", "wet", ["asia"], 0)]
_SUB = "canvas_id string, type string, st string, keywords array<string>, ord int"
_HITS = """, defs as (select * from (values ('item', 'ring', ['ring', 'loop'], 0), ('item', 'blue', ['blue', 'small'], 1), ('item', 'economy', ['ECONOMY'], 2), ('reg', 'wet', ['asia'], 0)) t(type, st, keywords, place)),
 hits as (select n.id, n.type, d.st, place, len(list_filter(keywords, lambda w: contains(lower(concat_ws(' ', label, sub)), lower(w)))) as n from nodes n join defs d on d.type = n.type),
 classed as (select id, type, max_by(st, (n, -place)) as st from hits where n > 0 group by id, type)"""


@query(g(_HITS + " select 'main' as canvas_id, id, st from classed"))
def i18_classify(spark, d) -> DataFrame:
    return q.classify(all_nodes(spark, d), spark.createDataFrame(SUBTYPES, _SUB))


@query(g(_HITS + " select 'main' as canvas_id, n.id, n.type, c.st from nodes n left join classed c on c.id = n.id"))
def w15_assign_subtypes(spark, d) -> DataFrame:
    """Nodes with their subtypes; what was assigned before stays."""
    nodes = all_nodes(spark, d)
    found = q.classify(nodes, spark.createDataFrame(SUBTYPES, _SUB)).withColumnRenamed("st", "new")
    return nodes.join(found, ["canvas_id", "id"], "left").select("canvas_id", "id", "type", F.coalesce("st", "new").alias("st"))


@query(g(_HITS + " select 'main' as canvas_id, 'bad-subtype' as kind, id, st as other, 80 as confidence from classed where (type, st) not in (select * from (values ('item', 'ring'), ('reg', 'wet')))"))
def q8_undefined_subtypes(spark, d) -> DataFrame:
    nodes = all_nodes(spark, d)
    defs = spark.createDataFrame(SUBTYPES, _SUB)
    given = nodes.drop("st").join(q.classify(nodes, defs), ["canvas_id", "id"])
    return q.undefined_subtypes(given, defs.where("st in ('ring', 'wet')"))


DEFS = [("main", "item", "price", "number", [], True), ("main", "item", "material", "enum", ["Brand#1", "Brand#2", "Brand#3"], False), ("main", "proj", "market", "number", [], True), ("main", "fm", "severity", "enum", ["9", "8"], False)]
_DEF = "canvas_id string, type string, key string, datatype string, options array<string>, required boolean"


@query(g(" select 'main' as canvas_id, 'missing-prop' as kind, id, 'price' as other, 60 as confidence from nodes where type = 'item' and id not like 'IP%'"))
def q9_missing_properties(spark, d) -> DataFrame:
    return q.missing_properties(all_nodes(spark, d), spark.createDataFrame(DEFS, _DEF))


@query(
    g(""", p as (select id, type, unnest(props) as p from nodes) select 'main' as canvas_id, 'bad-datatype' as kind, id, p.k as other, 70 as confidence from p
    where type = 'item' and p.k = 'material' and p.v not in ('Brand#1', 'Brand#2', 'Brand#3') or type = 'proj' and p.k = 'market' or type = 'fm' and p.k = 'severity' and p.v not in ('9', '8')""")
)
def q10_bad_datatypes(spark, d) -> DataFrame:
    return q.bad_datatypes(all_nodes(spark, d), spark.createDataFrame(DEFS, _DEF))


def _rule(name: str, alias: str) -> str:
    """The SQL of a registered rule as a table of a larger query."""
    return f"{alias} as ({ORACLES[name]})"


_RULES = "q1_auto_duplicates q2_label_duplicates q4_orphans q5_without_evidence q6_master_gaps q7_relation_domains q8_undefined_subtypes q9_missing_properties q10_bad_datatypes".split()
_MEANT = """close as (select 'main' as canvas_id, 'dup-semantic' as kind, 'IP' || p_partkey as id, 'IP' || (p_partkey - 64) as other, 50 as confidence from part where p_partkey >= 64 and p_partkey % 2 = 0
  union all select canvas_id, 'dup-semantic', id, other, 50 from every where kind = 'dup-candidate')"""


@query(
    "with " + ", ".join(_rule(n, n.split("_")[0]) for n in _RULES) + ", every as (" + " union all ".join(f"select canvas_id, kind, id, other, confidence from {n.split('_')[0]}" for n in _RULES) + f"), {_MEANT}, "
    """best as (select * from every where confidence >= 40 qualify row_number() over (partition by kind order by confidence desc, id, other) <= 8),
    more as (select * from close where (id, other) not in (select (id, other) from best where kind = 'dup-candidate') qualify row_number() over (partition by kind order by confidence desc, id, other) <= 8)
    select * from best union all select * from more"""
)
def q11_combined_scan(spark, d) -> DataFrame:
    """The best eight findings of each of the ten rules; pairs close in meaning come after those alike in spelling, and never twice."""
    found = [QUERIES[name](spark, d).select("canvas_id", "kind", "id", "other", "confidence") for name in _RULES]
    number = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    parts = all_nodes(spark, d).where("id like 'IP%'").where((number >= 64) & (number % 2 == 0))
    near = parts.select("canvas_id", F.lit("dup-semantic").alias("kind"), "id", F.concat(F.lit("IP"), (number - 64).cast("string")).alias("other"), F.lit(50).alias("confidence"))
    alike = settle(found[0].unionByName(found[1]))
    near = near.unionByName(alike.where("kind = 'dup-candidate'").withColumns({"kind": F.lit("dup-semantic"), "confidence": F.lit(50)}))
    return q.combined(alike, *found[2:], semantic=near, cap=8)
