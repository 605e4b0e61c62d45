"""Queries on contradictions, expansions of failure modes, audits of standards and review contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import contradictions as con
from kgspark.operators import review as rev
from kgspark.operators.lineage import settle
from kgspark.sources.tables import Graph, graph, table

from .graph import g
from .registry import query

c = F.col

# The graph with what is said about every third project, with standards, and with documents behind projects, failure modes, causes and actions.
_PROVEN = """, n2 as (select canvas_id, id, type, label, case when type = 'proj' and cast(substr(id, 3) as bigint) % 3 = 0 then list_append(props, {'k': '소비자언급.fog', 'v': (cast(substr(id, 3) as bigint) % 13) || ' times'}) else props end as props, ord from nodes
   union all select 'main', 'M' || d, 'master', 'standard ' || d, [{'k': '항목1', 'v': p || ' check·fog vent 20'}, {'k': '항목2', 'v': 'seal, 10 99'}], 650000 + d from (select distinct cast(substr(o_orderpriority, 1, 1) as int) as d, o_orderpriority as p from orders)),
 e2 as (select src, rel, dst, weight, ord from edges
   union all select distinct h.dst, 'EVIDENCED_BY', e.dst, cast(null as double), 200000000000000000 + e.ord - 100000000000000000 from edges h join edges e on e.rel = 'EVIDENCED_BY' and e.src = h.src where h.rel = 'HAS_FAILURE'
   union all select distinct 'C' || substr(h.dst, 4, 1), 'EVIDENCED_BY', e.dst, null, 300000000000000000 + e.ord - 100000000000000000 from edges h join edges e on e.rel = 'EVIDENCED_BY' and e.src = h.src where h.rel = 'HAS_FAILURE' and (e.ord - 100000000000000000) % 2 = 0
   union all select distinct m.dst, 'EVIDENCED_BY', e.dst, null, 400000000000000000 + e.ord - 100000000000000000 from edges m join edges h on h.rel = 'HAS_FAILURE' and h.dst = m.src join edges e on e.rel = 'EVIDENCED_BY' and e.src = h.src where m.rel = 'MITIGATED_BY' and (e.ord - 100000000000000000) % 3 = 2
   union all select 'PJ' || c_custkey, 'EVIDENCED_BY', 'D' || (c_custkey % docs), null, 500000000000000000 + c_custkey from customer, (select count(*) as docs from documents) where c_custkey % 2 = 0
   union all select distinct 'C' || substr(o_orderpriority, 1, 1), 'REF_MASTER', 'M' || substr(o_orderpriority, 1, 1), null, 600000000000000000 + cast(substr(o_orderpriority, 1, 1) as int) from orders where substr(o_orderpriority, 1, 1) <= '3'
   union all select distinct src, 'REF_MASTER', 'M4', null, 700000000000000000 + ord from edges where rel = 'CAUSED_BY' and substr(src, 4, 1) = '4'),
 ev as (select e.src as id, e.dst as doc, n.label as filename, row_number() over (partition by e.src order by e.ord, e.dst) as n from e2 e join n2 n on n.id = e.dst and n.type = 'doc' where e.rel = 'EVIDENCED_BY'),
 proof as (select id, count(*) as docs, list(filename order by n) filter (where n <= 2) as files, min_by(doc, n) as first from ev group by id),
 had as (select src as id, min_by(dst, ord) as fm from e2 where rel = 'OCCURRED_IN' and substr(dst, 4, 1) in ('1', '2') group by src)"""


def proven_graph(spark, d) -> Graph:
    gr = graph(spark, d)
    number = F.substring("id", 3, 30).try_cast("long")
    said = F.array_append("props", F.struct(F.lit("소비자언급.fog").alias("k"), F.concat((number % 13).cast("string"), F.lit(" times")).alias("v")))
    nodes = gr.nodes.withColumn("props", F.when((c("type") == "proj") & (number % 3 == 0), said).otherwise(c("props")))
    digit = F.substring("o_orderpriority", 1, 1)
    priorities = table(spark, d, "orders").select("o_orderpriority").distinct()
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    asks = F.array(pair("항목1", F.concat("o_orderpriority", F.lit(" check·fog vent 20"))), pair("항목2", F.lit("seal, 10 99")))
    none = F.lit(None).cast("string")
    masters = priorities.select(F.lit("main").alias("canvas_id"), F.concat(F.lit("M"), digit).alias("id"), F.lit("master").alias("type"), F.concat(F.lit("standard "), digit).alias("label"), none.alias("sub"), none.alias("st"), asks.alias("props"), (650_000 + digit.cast("int")).cast("long").alias("ord"))
    failing = gr.edges.where("rel = 'HAS_FAILURE'").select("src", c("dst").alias("fm"))
    shown = failing.join(gr.edges.where("rel = 'EVIDENCED_BY'").select("src", "dst", (c("ord") - 10**17).alias("o")), "src")
    edge = lambda df, src, rel, dst, order: df.select(F.lit("main").alias("canvas_id"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), F.lit(None).cast("double").alias("weight"), order.cast("long").alias("ord")).distinct()
    actions = gr.edges.where("rel = 'MITIGATED_BY'").select(c("src").alias("fm"), c("dst").alias("action"))
    docs = table(spark, d, "documents").agg(F.count("*").alias("docs"))
    own = table(spark, d, "customer").where("c_custkey % 2 = 0").join(F.broadcast(docs), F.lit(True))
    fm_digit = F.substring("fm", 4, 1)
    more = [
        edge(shown, c("fm"), "EVIDENCED_BY", c("dst"), 2 * 10**17 + c("o")),
        edge(shown.where("o % 2 = 0"), F.concat(F.lit("C"), fm_digit), "EVIDENCED_BY", c("dst"), 3 * 10**17 + c("o")),
        edge(shown.where("o % 3 = 2").join(actions, "fm"), c("action"), "EVIDENCED_BY", c("dst"), 4 * 10**17 + c("o")),
        edge(own, F.concat(F.lit("PJ"), "c_custkey"), "EVIDENCED_BY", F.concat(F.lit("D"), c("c_custkey") % c("docs")), 5 * 10**17 + c("c_custkey")),
        edge(priorities.where(digit <= "3"), F.concat(F.lit("C"), digit), "REF_MASTER", F.concat(F.lit("M"), digit), 6 * 10**17 + digit.cast("int")),
        edge(gr.edges.where("rel = 'CAUSED_BY' and substr(src, 4, 1) = '4'"), c("src"), "REF_MASTER", F.lit("M4"), 7 * 10**17 + c("ord")),
    ]
    edges = gr.edges
    for part in more:
        edges = edges.unionByName(part)
    return Graph(nodes.unionByName(masters), edges)


def wanted():
    """Condition on a failure mode: the two most severe kinds."""
    return F.substring("label", 4, 1).isin("1", "2")


_GAPS = _PROVEN + """, said as (select id, ord, i, p.v as detail, coalesce(try_cast(regexp_extract(p.v, '([0-9]+)', 1) as int), 1) as n from (select id, ord, unnest(props) as p, generate_subscripts(props, 1) as i from n2 where type = 'proj') where p.k = '소비자언급.fog'),
 rg as (select 'record-gap' as kind, s.id, 'fog' as other, detail, list_concat(['소비자언급.fog'], files) as evidence, [s.id || '→EVIDENCED_BY→' || first] as trace,
   cast(floor(least(0.5::double + least(n / 8.0::double, 1) * 0.3::double + least(docs / 5.0::double, 1) * 0.2::double, 1) * 100 + 0.5) as int) as confidence, ord, i as o2 from said s join proof using (id) where id not in (select id from had)),
 near as (select src as id, dst as other, weight, 'out' as dir, ord as link from edges where rel = 'SIMILAR' union all select dst, src, weight, 'in', ord from edges where rel = 'SIMILAR'),
 mg as (select 'market-env' as kind, p.id, n.other, h.fm as detail, list_concat([h.fm], coalesce(files, [])) as evidence, [case when dir = 'out' then p.id || '→SIMILAR→' || n.other else n.other || '→SIMILAR→' || p.id end, n.other || '→OCCURRED_IN→' || h.fm] as trace,
   cast(floor(least(0.55::double * weight + 0.25::double * least(coalesce(docs, 0) / 10.0::double, 1) + 0.2::double, 1) * 100 + 0.5) as int) as confidence, p.ord, case when dir = 'out' then 0 else 1 end as o2, link
   from n2 p join near n on n.id = p.id join had h on h.id = n.other left join proof on proof.id = h.fm where p.type = 'proj' and (select p2.v from (select unnest(p.props) as p2) where p2.k = 'market') in ('ASIA', 'MIDDLE EAST') and p.id not in (select id from had))"""


@query(g(_GAPS + " select kind, id, other, detail, evidence, trace, confidence from rg where confidence >= 40"))
def g9_record_gaps(spark, d) -> DataFrame:
    """What is said about projects without such a failure on record."""
    gr = proven_graph(spark, d)
    return con.record_gaps(gr.nodes, gr.edges, wanted(), top=None).drop("canvas_id")


@query(g(_GAPS + " select kind, id, other, detail, evidence, trace, confidence from mg where confidence >= 40"))
def g10_market_gaps(spark, d) -> DataFrame:
    """Projects for two regions next to a similar one with a failure that they have not had."""
    gr = proven_graph(spark, d)
    return con.market_gaps(gr.nodes, gr.edges, wanted(), ("ASIA", "MIDDLE EAST"), top=None).drop("canvas_id")


@query(
    g(_GAPS + """ select kind, id, other, confidence from (select *, row_number() over (order by confidence desc, ord, o2) as place from rg where confidence >= 40) where place <= 5
    union all select kind, id, other, confidence from (select *, row_number() over (order by confidence desc, ord, o2, link) as place from mg where confidence >= 40) where place <= 5""")
)
def u1_union_of_rules(spark, d) -> DataFrame:
    """Both rules of the contradiction scan, the five most certain findings of each."""
    gr = proven_graph(spark, d)
    return con.contradictions(gr.nodes, gr.edges, wanted(), ("ASIA", "MIDDLE EAST")).select("kind", "id", "other", "confidence")


@query(
    g(_PROVEN + """, steps as (select h.dst as anchor, h.src as id, h.ord as i from e2 h where h.rel = 'HAS_FAILURE'), sh as (select s.anchor, s.id, count(*) as shared from steps s join (select distinct id, doc from ev) a on a.id = s.id join (select distinct id, doc from ev) b on b.id = s.anchor and b.doc = a.doc group by s.anchor, s.id)
    select s.anchor, s.id, coalesce(shared, 0) as shared, row_number() over (partition by s.anchor order by coalesce(shared, 0) desc, i) as place from steps s left join sh using (anchor, id)""")
)
def k12_evidence_rerank(spark, d) -> DataFrame:
    """Parts with a failure mode, those that share documents with it first."""
    gr = proven_graph(spark, d)
    steps = gr.edges.where("rel = 'HAS_FAILURE'").select("canvas_id", c("dst").alias("anchor"), c("src").alias("id"), c("ord").alias("i"))
    return rev.by_shared_evidence(steps, gr.nodes, gr.edges).select("anchor", "id", "shared", "place")


_EXPANDED = _PROVEN + """, fm as (select id as fm from n2 where type = 'fm'), u as (select distinct id, doc from ev), ov as (select a.id, b.id as anchor, count(*) as shared from u a join u b on a.doc = b.doc group by a.id, b.id),
 cz as (select e.src as fm, e.dst as id, e.ord, row_number() over (partition by e.src order by coalesce(shared, 0) desc, e.ord) as place from e2 e join fm on fm = e.src left join ov on ov.id = e.dst and ov.anchor = e.src where rel = 'CAUSED_BY'),
 st as (select src as fm, rel, dst as id, 0 as p, ord from e2 join fm on fm = src where rel in ('REF_MASTER', 'MITIGATED_BY') union all select cz.fm, e.rel, e.dst, cz.place, e.ord from cz join e2 e on e.src = cz.id and e.rel in ('REF_MASTER', 'MITIGATED_BY')),
 sb as (select st.fm, rel, n.label, row_number() over (partition by st.fm, rel order by coalesce(shared, 0) desc, p, st.ord) as place from st join n2 n on n.id = st.id left join ov on ov.id = st.id and ov.anchor = st.fm),
 dd as (select id as fm, n, filename from ev where n <= 2 union all select cz.fm, 3, filename from cz join ev on ev.id = cz.id and ev.n = 1 where place = 1),
 de as (select fm, list(filename order by n) as docs from (select fm, filename, min(n) as n from dd group by fm, filename) group by fm)"""


@query(
    g(_EXPANDED + """ select fm, coalesce((select list(n.label order by place) from cz join n2 n on n.id = cz.id where cz.fm = fm.fm and place <= 3), []) as causes, (select label from sb where sb.fm = fm.fm and rel = 'REF_MASTER' and place = 1) as master,
    (select label from sb where sb.fm = fm.fm and rel = 'MITIGATED_BY' and place = 1) as action, coalesce((select list(n.label order by e.ord) from e2 e join n2 n on n.id = e.dst where e.src = fm.fm and e.rel = 'UNDER_REG'), []) as regs, coalesce(docs, []) as docs from fm left join de using (fm)""")
)
def g13_expansions(spark, d) -> DataFrame:
    """Causes, standard, action, rules and documents behind every failure mode."""
    gr = proven_graph(spark, d)
    return rev.expansions(gr.nodes, settle(gr.edges)).drop("canvas_id")


@query(
    """with ot as (select distinct substr(o_orderpriority, 1, 1) as m, o_orderpriority as p from orders), req as (select 'M' || m as master, 'standard ' || m as label, unnest([p || ' check', 'fog vent 20', 'seal', '10 99']) as item, unnest([0, 1, 2, 3]) as o from ot),
    con as (select 'M' || (1 + doc_id % 4) as master, lower(text) as text from documents where text is not null),
    tk as (select master, label, item, o, list_filter(regexp_split_to_array(lower(item), '\\s+'), lambda t: length(t) >= 2 and not regexp_matches(t, '^[0-9]')) as t from req),
    fl as (select master, label, item, o, unnest(case when len(t) > 0 then t else [lower(item)] end) as t from tk),
    hit as (select f.*, exists (select 1 from con k where k.master = f.master and (contains(k.text, f.t) or (f.t = 'vent' and contains(k.text, 'the')) or (f.t = 'fog' and contains(k.text, 'zzzz')))) as h from fl f),
    rt as (select master, label, item, o, avg(case when h then 1.0 else 0.0 end) as r from hit group by all)
    select master, label, list(item order by o) as required, coalesce(list(item order by o) filter (where r >= 1), []) as covered, coalesce(list(item order by o) filter (where r > 0 and r < 1), []) as unknown, coalesce(list(item order by o) filter (where r = 0), []) as missing
    from rt where master in (select master from con) group by master, label"""
)
def g17_master_audit(spark, d) -> DataFrame:
    """What of the standards' items all documents, dealt to four of them, deal with."""
    masters = proven_graph(spark, d).nodes.where("type = 'master'")
    concerns = table(spark, d, "documents").where("text is not null").select(F.lit("main").alias("canvas_id"), F.concat(F.lit("M"), 1 + c("doc_id") % 4).alias("master"), "text")
    synonyms = spark.createDataFrame([("vent", "the"), ("fog", "zzzz")], "base string, word string")
    return rev.master_audit(concerns, masters, synonyms).drop("canvas_id")


@query(
    """with e as (select user_id as cid, row_number() over (partition by user_id order by value desc, event_id) as no, event_type as title, event_type || ' ' || repeat('x', event_id % 200) as de, cast(floor(value) as int) as confidence from events),
    a as (select c_custkey as cid, 'standard ' || c_nationkey || ': 필수 4항목 중 ' || (c_custkey % 5) || ' 커버' || case when c_custkey % 5 < 4 then ' — 누락: ' || array_to_string(['a', 'b', 'c', 'd'][(c_custkey % 5) + 1:least((c_custkey % 5) + 3, 4)], ', ') || case when c_custkey % 5 = 0 then ' 외' else '' end else '' end as l from customer),
    t as (select list(p_name order by p_partkey) as contradictions from (select p_partkey, p_name from part order by p_partkey limit 5))
    select cid, coalesce((select list(no || '. ' || title || ' — ' || case when length(de) > 120 then de[1:120] || '…' else de end || ' (' || confidence || '%)' order by no) from e where e.cid = k.cid and no <= 8), []) as checks,
      coalesce((select list(l) from a where a.cid = k.cid), []) as audits, contradictions from (select cid from e union select cid from a) k, t"""
)
def t15_review_context(spark, d) -> DataFrame:
    """Checks, audits and contradictions as lines, for every user and customer."""
    ev, cust = table(spark, d, "events"), table(spark, d, "customer")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    text = F.concat("event_type", F.lit(" "), F.expr("repeat('x', cast(event_id % 200 as int))"))
    checks = ev.select(c("user_id").alias("cid"), no.alias("no"), c("event_type").alias("title"), text.alias("desc"), F.floor("value").cast("int").alias("confidence"))
    asked, k = F.array(*(F.lit(x) for x in "abcd")), (c("c_custkey") % 5).cast("int")
    audits = cust.select(c("c_custkey").alias("cid"), F.concat(F.lit("standard "), "c_nationkey").alias("label"), asked.alias("required"), F.slice(asked, F.lit(1), k).alias("covered"), F.slice(asked, k + 1, F.lit(4)).alias("missing"))
    return rev.review_contexts(checks, audits, table(spark, d, "part").select(c("p_name").alias("title"), c("p_partkey").alias("ord")))
