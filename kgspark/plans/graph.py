"""Queries on the graph: scans, lookups, joins, counts, rankings and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import components as cc
from kgspark.operators import graph as op
from kgspark.operators import ingest, schema
from kgspark.operators.lineage import settle
from kgspark.sources.tables import GRAPH_SQL, graph, table
from kgspark.sources.tables import edges as all_edges
from kgspark.sources.tables import nodes as all_nodes

from .registry import query


def g(body: str) -> str:
    return "with " + GRAPH_SQL + body


@query(g(" select canvas_id, id, type, label, sub, st, ord from nodes where canvas_id = 'main'"))
def s1_load_nodes(spark, d) -> DataFrame:
    """Snapshot of one canvas, pruned to it."""
    return all_nodes(spark, d).where("canvas_id = 'main'").select("canvas_id", "id", "type", "label", "sub", "st", "ord")


@query(g(" select canvas_id, src, rel, dst, weight, ord from edges where canvas_id = 'main'"))
def s1_load_edges(spark, d) -> DataFrame:
    return all_edges(spark, d).where("canvas_id = 'main'")


@query(g(" select canvas_id, count(*) filter (where type <> 'doc') as objects, count(*) filter (where type = 'doc') as documents, (select count(*) from edges) as relations from nodes group by canvas_id"))
def s15_canvas_counts(spark, d) -> DataFrame:
    """Canvases with their counts: two grouped counts joined, not a subquery per row."""
    gr = graph(spark, d)
    n = gr.nodes.groupBy("canvas_id").agg(F.count_if(F.col("type") != "doc").alias("objects"), F.count_if(F.col("type") == "doc").alias("documents"))
    e = gr.edges.groupBy("canvas_id").agg(F.count("*").alias("relations"))
    return n.join(e, "canvas_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)).cast("long"))


@query(g(" select canvas_id, 'type' as what, type as name, count(*) as uses from nodes group by all union all select canvas_id, 'relation', rel, count(*) from edges group by all"))
def s16_usage_counters(spark, d) -> DataFrame:
    """How often each object type and each relation type is used."""
    gr = graph(spark, d)
    types = gr.nodes.groupBy("canvas_id", F.lit("type").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("uses"))
    return types.unionByName(gr.edges.groupBy("canvas_id", F.lit("relation").alias("what"), F.col("rel").alias("name")).agg(F.count("*").alias("uses")))


@query(
    g(""", more as (select canvas_id, src, rel, dst, weight, ord from edges union all select canvas_id, src, rel, 'gone', weight, ord + 1 from edges where rel = 'CAUSED_BY'
      union all select canvas_id, src, rel, dst, 9.0, ord + 5 from edges where rel = 'UNDER_REG'),
    kept as (select *, row_number() over (partition by canvas_id, src, rel, dst order by ord) as place from more)
    select canvas_id, src, rel, dst, weight, ord from kept where place = 1 and src in (select id from nodes) and dst in (select id from nodes)""")
)
def p1_intact_edges(spark, d) -> DataFrame:
    """Edges with both ends, the first of each key; broken and repeated ones are added first."""
    gr = graph(spark, d)
    gone = gr.edges.where("rel = 'CAUSED_BY'").withColumns({"dst": F.lit("gone"), "ord": F.col("ord") + 1})
    again = gr.edges.where("rel = 'UNDER_REG'").withColumns({"weight": F.lit(9.0), "ord": F.col("ord") + 5})
    return op.intact(gr.nodes, gr.edges.unionByName(gone).unionByName(again))


@query(g(" select n.canvas_id, n.id, count(e.id) as degree from nodes n left join (select src as id from edges union all select dst from edges) e on n.id = e.id group by n.canvas_id, n.id"))
def a3_degree(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return op.with_degree(gr.nodes.select("canvas_id", "id"), gr.edges)


@query(
    g(""" select canvas_id, id, list_filter(props, lambda p: p.k = 'material')[1].v as material,
    list_filter(props, lambda p: contains(lower(p.k), 'segm'))[1].v as segment from nodes where type in ('item', 'proj')""")
)
def p2_prop_lookup(spark, d) -> DataFrame:
    """First property with a key, and first whose folded key holds a fragment."""
    first = lambda cond: F.get(F.filter("props", cond), F.lit(0))["v"]
    rows = all_nodes(spark, d).where(F.col("type").isin("item", "proj"))
    return rows.select("canvas_id", "id", first(lambda p: p["k"] == "material").alias("material"), first(lambda p: F.lower(p["k"]).contains("segm")).alias("segment"))


@query(
    g(""" select canvas_id, id, coalesce(try_cast(nullif(regexp_extract(list_filter(props, lambda p: regexp_matches(p.k, 'sever'))[1].v, '-?[0-9]+'), '') as int), 5) as severity,
     case when severity >= 8 then 'high' when severity >= 6 then 'middle' else 'low' end as tier from nodes where type in ('fm', 'cause')""")
)
def p3_number_with_default(spark, d) -> DataFrame:
    value = F.get(F.filter("props", lambda p: p["k"].rlike("sever")), F.lit(0))["v"]
    severity = F.coalesce(F.regexp_extract(value, "-?[0-9]+", 0).try_cast("int"), F.lit(5))
    tier = F.when(F.col("severity") >= 8, "high").when(F.col("severity") >= 6, "middle").otherwise("low")
    return all_nodes(spark, d).where("type in ('fm', 'cause')").select("canvas_id", "id", severity.alias("severity")).withColumn("tier", tier)


@query(
    g(""" select canvas_id, id, lower(concat_ws(' ', label, sub, nullif(array_to_string(list_transform(props, lambda p: p.k || ' ' || p.v), ' '), ''))) as search_text,
    array_to_string(list_transform(list_filter(props, lambda p: regexp_matches(p.k, 'market|region')), lambda p: p.v), ' ') as market_text from nodes where type <> 'doc'""")
)
def p4_search_text(spark, d) -> DataFrame:
    """Text that searches look at, and the part of it that tells the market."""
    text = F.array_join(F.transform("props", lambda p: F.concat_ws(" ", p["k"], p["v"])), " ")
    market = F.array_join(F.transform(F.filter("props", lambda p: p["k"].rlike("market|region")), lambda p: p["v"]), " ")
    rows = all_nodes(spark, d).where("type <> 'doc'")
    return rows.select("canvas_id", "id", F.lower(F.concat_ws(" ", "label", "sub", F.nullif(text, F.lit("")))).alias("search_text"), market.alias("market_text"))


@query(
    g(""", seen as (select canvas_id, src as id, 'out' as dir, rel, dst as other from edges union all select canvas_id, dst, 'in', rel, src from edges)
    select s.canvas_id, s.id, s.dir, s.rel, s.other, coalesce(o.label, s.other) as other_label from seen s join nodes n on n.id = s.id and n.type = 'fm' left join nodes o on o.id = s.other""")
)
def p5_object_detail(spark, d) -> DataFrame:
    """Relations of every failure mode, in and out, with the labels of the other ends."""
    gr = graph(spark, d)
    objects = gr.nodes.where("type = 'fm'").select("canvas_id", "id")
    labels = gr.nodes.select("canvas_id", F.col("id").alias("other"), "label")
    seen = op.both_ways(gr.edges).join(objects, ["canvas_id", "id"]).join(labels, ["canvas_id", "other"], "left")
    return seen.select("canvas_id", "id", "dir", "rel", "other", F.coalesce("label", "other").alias("other_label"))


@query(g(" select e.canvas_id, e.src as id, e.dst as doc, n.label as filename, e.ord from edges e join nodes n on n.id = e.dst and n.type = 'doc' where e.rel = 'EVIDENCED_BY'"))
def p6_evidence(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return op.evidence(gr.nodes, gr.edges)


@query(
    g(""", ev as (select src, count(*) as n from edges where rel = 'EVIDENCED_BY' group by src)
    select canvas_id, id, type, label, array_to_string(list_transform(props[1:3], lambda p: p.k || ': ' || p.v), ' / ') as summary, coalesce(n, 0) as evidence
    from nodes left join ev on src = id where type <> 'doc'""")
)
def p7_node_rows(spark, d) -> DataFrame:
    """Table view of objects: first three properties and number of documents."""
    gr = graph(spark, d)
    count = gr.edges.where("rel = 'EVIDENCED_BY'").groupBy("canvas_id", F.col("src").alias("id")).agg(F.count("*").alias("evidence"))
    summary = F.array_join(F.transform(F.slice("props", 1, 3), lambda p: F.concat_ws(": ", p["k"], p["v"])), " / ")
    rows = gr.nodes.where("type <> 'doc'").select("canvas_id", "id", "type", "label", summary.alias("summary"))
    return rows.join(count, ["canvas_id", "id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)).cast("long"))


@query(g(" select e.canvas_id, coalesce(s.label, e.src) as src_label, e.rel, coalesce(t.label, e.dst) as dst_label, e.weight from edges e left join nodes s on s.id = e.src left join nodes t on t.id = e.dst where e.rel <> 'EVIDENCED_BY'"))
def p8_relation_rows(spark, d) -> DataFrame:
    """Table view of relations without evidence links; ids stand in for missing labels."""
    gr = graph(spark, d)
    label = lambda end: gr.nodes.select("canvas_id", F.col("id").alias(end), F.col("label").alias(f"{end}_name"))
    rows = gr.edges.where("rel <> 'EVIDENCED_BY'").join(label("src"), ["canvas_id", "src"], "left").join(label("dst"), ["canvas_id", "dst"], "left")
    return rows.select("canvas_id", F.coalesce("src_name", "src").alias("src_label"), "rel", F.coalesce("dst_name", "dst").alias("dst_label"), "weight")


@query(g(" select e.canvas_id, e.src, e.rel, e.dst from edges e join nodes s on s.id = e.src join nodes t on t.id = e.dst where s.type in ('proj', 'fm') and t.type in ('proj', 'fm') and not (e.rel = 'EVIDENCED_BY' or e.rel = 'SIMILAR' and coalesce(e.weight, 0) < 0.7)"))
def p9_view_filter(spark, d) -> DataFrame:
    """Edges of a view restricted to types, without evidence and weak similarity."""
    gr = graph(spark, d)
    shown = gr.nodes.where(F.col("type").isin("proj", "fm"))
    weak = (F.col("rel") == "SIMILAR") & (F.coalesce("weight", F.lit(0.0)) < 0.7)
    rows = gr.edges.where((F.col("rel") != "EVIDENCED_BY") & ~weak).select(*op.KEY)
    return rows.join(op.ids(shown, "src"), ["canvas_id", "src"], "left_semi").join(op.ids(shown, "dst"), ["canvas_id", "dst"], "left_semi").select("canvas_id", "src", "rel", "dst")


REQUIRED = {"inference": ["fm", "proj", "cause"], "drawing": ["drawing", "item"], "regulation": ["reg", "fm"], "search": []}
_NEEDS_SQL = " union all ".join(f"select '{k}' as feature, cast({v!r} as varchar[]) as needed" for k, v in REQUIRED.items())


@query(g(f", needs as ({_NEEDS_SQL}), have as (select canvas_id, list(distinct type) as types from nodes group by canvas_id) select canvas_id, feature, list_has_all(types, needed) as available from have, needs"))
def p10_capabilities(spark, d) -> DataFrame:
    """Which features a canvas can offer, by the types it has."""
    needs = spark.createDataFrame(list(REQUIRED.items()), "feature string, needed array<string>")
    have = all_nodes(spark, d).groupBy("canvas_id").agg(F.collect_set("type").alias("types"))
    return have.join(F.broadcast(needs), F.lit(True)).select("canvas_id", "feature", (F.size(F.array_except("needed", "types")) == 0).alias("available"))


@query(
    g(""", asked as (select n_name as q from nation union select p_name from part union all select 'NATION' union all select 'xx AFRICA xx' union all select 'no'),
    hits as (select q, id, case when lower(label) = lower(q) then 0 else 1 end as rank, ord from asked join nodes on type in ('item', 'reg')
      and (lower(label) = lower(q) or length(q) >= 3 and length(label) >= 3 and (contains(lower(label), lower(q)) or contains(lower(q), lower(label)))))
    select q, min_by(id, (rank, ord)) as id from hits group by q""")
)
def p11_resolve_text(spark, d) -> DataFrame:
    """Node that a text names: equal label first, else one holds the other; ties by insertion."""
    asked = table(spark, d, "nation").select(F.col("n_name").alias("q")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("q"))).distinct()
    asked = asked.union(spark.createDataFrame([("NATION",), ("xx AFRICA xx",), ("no",)], "q string"))
    return ingest.resolved_texts(asked, all_nodes(spark, d).where("type in ('item', 'reg')"))


@query(
    """with hops as (select c_custkey % 7 as grp, c_custkey as pos, 'n' || (c_custkey - c_custkey % 7) as a, 'n' || (c_custkey - c_custkey % 7 + case when c_custkey % 3 = 0 then 1 else 7 end) as b from customer),
    cut as (select *, case when lag(b) over w = a then 0 else 1 end as new from hops window w as (partition by grp order by pos)),
    runs as (select *, sum(new) over (partition by grp order by pos) as chain from cut)
    select grp, cast(chain as bigint) as chain, min_by(a, pos) || '→' || string_agg(b, '→' order by pos) as path from runs group by grp, chain"""
)
def p12_hop_chains(spark, d) -> DataFrame:
    """Hop strings "a→rel→b" read back and joined to chains where one ends at the next one's start."""
    key = F.col("c_custkey")
    start = key - key % 7
    hop = F.concat(F.lit("n"), start, F.lit("→REL→n"), start + F.when(key % 3 == 0, 1).otherwise(7))
    hops = table(spark, d, "customer").select((key % 7).alias("grp"), key.alias("pos"), F.split(hop, "→").alias("h"))
    hops = hops.select("grp", "pos", F.col("h")[0].alias("a"), F.col("h")[2].alias("b"))
    order = Window.partitionBy("grp").orderBy("pos")
    new = F.when(F.lag("b").over(order) == F.col("a"), 0).otherwise(1)
    runs = hops.withColumn("new", new).withColumn("chain", F.sum("new").over(order))
    ends = F.array_sort(F.collect_list(F.struct("pos", "b")))
    return runs.groupBy("grp", "chain").agg(F.concat_ws("→", F.min_by("a", "pos"), F.array_join(F.transform(ends, lambda x: x["b"]), "→")).alias("path"))


@query(g(" select distinct p.k as key, trim(p.v) as value from (select unnest(props) as p from nodes where type = 'proj') where trim(p.v) <> '' and not regexp_matches(p.v, '^(-|n/a|none)$')"))
def p13_condition_options(spark, d) -> DataFrame:
    """Values that a project property takes, without noise."""
    props = all_nodes(spark, d).where("type = 'proj'").select(F.explode("props").alias("p")).select(F.col("p.k").alias("key"), F.trim("p.v").alias("value"))
    return props.where("value <> ''").where(~F.col("value").rlike("^(-|n/a|none)$")).distinct()


@query(
    """select event_id, list_filter([case when event_type is null then 'event_type missing' end, case when length(event_type) > 6 then 'event_type too long' end,
    case when event_type not in ('click', 'view', 'purchase', 'error') then 'event_type unknown' end, case when value < 0 or value > 100 then 'value out of range' end], lambda x: x is not null) as faults from events"""
)
def p14_input_contract(spark, d) -> DataFrame:
    """Faults of each input row against required fields, lengths, lists and ranges; rows without faults are valid."""
    kind, value = F.col("event_type"), F.col("value")
    rules = [
        (kind.isNull(), "event_type missing"),
        (F.length(kind) > 6, "event_type too long"),
        (~kind.isin("click", "view", "purchase", "error"), "event_type unknown"),
        ((value < 0) | (value > 100), "value out of range"),
    ]
    return table(spark, d, "events").select("event_id", F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules))).alias("faults"))


@query(g(" select e.canvas_id, a.id as anchor, e.rel, n.id, n.label from nodes a join edges e on e.src = a.id and e.rel in ('HAS_FAILURE', 'EVIDENCED_BY') join nodes n on n.id = e.dst where a.type = 'item' and a.label like 'blue%'"))
def j1_follow(spark, d) -> DataFrame:
    gr = graph(spark, d)
    anchors = gr.nodes.where("type = 'item' and label like 'blue%'").select("canvas_id", F.col("id").alias("anchor"))
    return op.follow(anchors, gr.nodes, gr.edges, ["HAS_FAILURE", "EVIDENCED_BY"])


@query(g(" select canvas_id, id from nodes where type = 'item' and id not in (select src from edges where rel = 'EVIDENCED_BY')"))
def j3_missing_evidence(spark, d) -> DataFrame:
    """Anti-join: items that nothing stands behind."""
    gr = graph(spark, d)
    return gr.nodes.where("type = 'item'").select("canvas_id", "id").join(op.ids(gr.edges.where("rel = 'EVIDENCED_BY'").withColumn("id", F.col("src")), "id"), ["canvas_id", "id"], "left_anti")


@query(g(", c as (select e.src as parent, n.id, n.ord, n.sub from edges e join nodes n on n.id = e.dst where e.rel = 'CONSISTS_OF' and n.sub is not null) select a.parent, a.id as one, b.id as other from c a join c b on a.parent = b.parent and a.ord < b.ord and a.sub = b.sub"))
def j6_sibling_pairs(spark, d) -> DataFrame:
    """Pairs of parts under one parent that share a sub-label, each once."""
    gr = graph(spark, d)
    parts = gr.nodes.where("sub is not null").select("canvas_id", F.col("id").alias("dst"), "sub", F.col("ord").alias("place"))
    child = gr.edges.where("rel = 'CONSISTS_OF'").select("canvas_id", "src", "dst").join(parts, ["canvas_id", "dst"])
    one, other = child.alias("a"), child.alias("b")
    pair = (F.col("a.canvas_id") == F.col("b.canvas_id")) & (F.col("a.src") == F.col("b.src")) & (F.col("a.sub") == F.col("b.sub")) & (F.col("a.place") < F.col("b.place"))
    return one.join(other, pair).select(F.col("a.src").alias("parent"), F.col("a.dst").alias("one"), F.col("b.dst").alias("other"))


@query(
    g(""", seen as (select canvas_id, src as id, rel, dst as other, 'out' as dir from edges where rel in ('SIMILAR', 'OCCURRED_IN') union all select canvas_id, dst, rel, src, 'in' from edges where rel in ('SIMILAR', 'OCCURRED_IN'))
    select canvas_id, id, rel, other, max(dir) as dir from seen group by canvas_id, id, rel, other""")
)
def g1_neighbours(spark, d) -> DataFrame:
    return op.neighbours(all_edges(spark, d), ["SIMILAR", "OCCURRED_IN"])


@query(
    g(""", links as (select distinct a, b from (select src as a, dst as b from edges union all select dst, src from edges) where a <> b),
    h0 as (select id as seed, id, 0 as hops from nodes where type = 'action'),
    h1 as (select distinct h0.seed, b as id from h0 join links on a = id where (h0.seed, b) not in (select seed, id from h0)),
    h2 as (select distinct h1.seed, b as id from h1 join links on a = id where (h1.seed, b) not in (select seed, id from h0 union all select seed, id from h1))
    select 'main' as canvas_id, seed, id, hops from h0 union all select 'main', seed, id, 1 from h1 union all select 'main', seed, id, 2 from h2""")
)
def g2_k_hop(spark, d) -> DataFrame:
    """Everything within two steps of each action, with least distances."""
    gr = graph(spark, d)
    return op.k_hop(gr.nodes.where("type = 'action'"), gr.edges, 2, settle)


_WAYS = """, links as (select distinct src as a, dst as b, src, rel, dst from edges where src <> dst union select dst, src, src, rel, dst from edges where src <> dst),
    h0 as (select id as seed, id, [id] as path from nodes where type = 'reg'),
    s1 as (select seed, a, b, path, src, rel, dst from h0 join links on a = id where b <> seed), h1 as (select seed, b as id, list_append(min(path), b) as path from s1 group by seed, b),
    s2 as (select seed, a, b, path, src, rel, dst from h1 join links on a = id where (seed, b) not in (select seed, id from h0 union all select seed, id from h1)), h2 as (select seed, b as id, list_append(min(path), b) as path from s2 group by seed, b)"""


@query(g(_WAYS + " select seed, id, 0 as hops, path from h0 union all select seed, id, 1, path from h1 union all select seed, id, 2, path from h2"))
def g2_paths(spark, d) -> DataFrame:
    """Everything within two steps of each region, with one shortest path."""
    gr = graph(spark, d)
    return op.shortest_ways(gr.nodes.where("type = 'reg'"), gr.edges, 2, settle)[0].drop("canvas_id")


@query(g(_WAYS + " select seed, src, rel, dst, 1 as hops from s1 union all select seed, src, rel, dst, 2 from s2"))
def g2_shortest_ways(spark, d) -> DataFrame:
    """The edges of all shortest ways to them."""
    gr = graph(spark, d)
    return op.shortest_ways(gr.nodes.where("type = 'reg'"), gr.edges, 2, settle)[1].drop("canvas_id")


@query(g(_WAYS + ", r as (select seed, id from h0 union all select seed, id from h1) select x.seed, e.src, e.rel, e.dst from r x join edges e on e.src = x.id join r y on y.seed = x.seed and y.id = e.dst"))
def g2_subgraph(spark, d) -> DataFrame:
    """All edges among what is one step from each region."""
    gr = graph(spark, d)
    reached = op.shortest_ways(gr.nodes.where("type = 'reg'"), gr.edges, 1, settle)[0]
    return op.hop_edges(reached, gr.edges).drop("canvas_id")


@query(
    g(""" select canvas_id, id, label, type, case when type = 'doc' then 'document' else 'entity' end as kind,
    (select count(*) from edges where rel = 'EVIDENCED_BY' and dst = id) as mentions from nodes""")
)
def g3_full_graph(spark, d) -> DataFrame:
    """Entities and documents as one table; documents with the number of entities they mention."""
    gr = graph(spark, d)
    view, links = op.documents_as_nodes(gr.nodes, gr.edges)
    count = links.where("rel = 'MENTIONS'").groupBy("canvas_id", F.col("src").alias("id")).agg(F.count("*").alias("mentions"))
    return view.join(count, ["canvas_id", "id"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)).cast("long"))


@query(
    g(""", s as (select distinct src as a, dst as b from edges where rel = 'CONSISTS_OF' and src <> dst),
    ways as (select x.a as src, y.b as dst, 1 as n, [x.b] as via from s x join s y on x.b = y.a where x.a <> y.b
      union all select x.a, z.b, 2, [x.b, y.b] from s x join s y on x.b = y.a join s z on y.b = z.a where x.a <> y.b and z.b <> x.a and z.b <> x.b)
    select 'main' as canvas_id, src, dst, min_by(via, (n, via)) as via, cast(0.85 as double) as confidence from ways where (src, dst) not in (select a, b from s) group by src, dst""")
)
def g4_transitive_closure(spark, d) -> DataFrame:
    return op.transitive(all_edges(spark, d))


@query(g(", s as (select src, dst, weight from edges where rel = 'SIMILAR') select 'main' as canvas_id, dst as src, src as dst, cast(coalesce(weight, 0.7) as double) as confidence from s where (dst, src) not in (select src, dst from s)"))
def g5_symmetric_closure(spark, d) -> DataFrame:
    return op.symmetric(all_edges(spark, d))


@query(
    g(""" select 'main' as canvas_id, a.src, b.dst, min(a.dst) as via, cast(0.7 as double) as confidence from edges a join edges b on a.dst = b.src and a.rel = 'CONSISTS_OF' and b.rel = 'HAS_FAILURE'
    where (a.src, b.dst) not in (select src, dst from edges where rel = 'HAS_FAILURE') group by a.src, b.dst""")
)
def g6_failure_chain(spark, d) -> DataFrame:
    return op.chained(all_edges(spark, d))


@query(g(", p as (select c_custkey, c_nationkey, c_mktsegment from customer) select 'PJ' || c_custkey as node, min('PJ' || c_custkey) over (partition by c_nationkey, c_mktsegment) as component from p qualify count(*) over (partition by c_nationkey, c_mktsegment) > 1"))
def g12_components(spark, d) -> DataFrame:
    """Groups of projects that similarity links connect."""
    links = all_edges(spark, d).where("rel = 'SIMILAR'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = cc.components(links)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


@query(g(" select 'type' as what, type as name, count(*) as n, min(ord) as first_ord from nodes group by type union all select 'rel', rel, count(*), min(ord) from edges group by rel"))
def a1_tallies(spark, d) -> DataFrame:
    """Counts of types and relations with the place of their first appearance, which breaks ties."""
    gr = graph(spark, d)
    tally = lambda df, what, name: df.groupBy(F.lit(what).alias("what"), F.col(name).alias("name")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return tally(gr.nodes, "type", "type").unionByName(tally(gr.edges, "rel", "rel")).orderBy("what", F.desc("n"), "first_ord")


@query(g(" select type, coalesce(sub, '(none)') as sub, cast(grouping(type, coalesce(sub, '(none)')) as bigint) as level, count(*) as n from nodes where type <> 'doc' group by rollup (type, coalesce(sub, '(none)'))"))
def a2_type_totals(spark, d) -> DataFrame:
    """Counts by type and subtype with subtotals."""
    rows = all_nodes(spark, d).where("type <> 'doc'").select("type", F.coalesce("sub", F.lit("(none)")).alias("sub"))
    return rows.rollup("type", "sub").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


TYPE_ORDER = ["item", "fm", "cause", "action", "reg", "proj", "master", "spec"]  # fixed values: the order of types in trees and catalogs


@query(
    g(""", o as (select * from (values ('item', 0), ('fm', 1), ('cause', 2), ('action', 3), ('reg', 4), ('proj', 5)) t(type, type_place)), defs as (select * from (values ('item', 'PROMO', 0), ('item', 'ECONOMY', 1), ('item', 'UNUSED', 2), ('reg', 'x', 0)) t(type, st, st_place)),
    r as (select n.id, n.type, n.label, type_place, case when n.type in ('item', 'reg') then coalesce(d.st, '미분류') end as st, case when n.type in ('item', 'reg') then coalesce(d.st_place, 2147483647) end as st_place from nodes n join o using (type) left join defs d on d.type = n.type and d.st = n.sub)
    select 'root' as kind, null as type, null as st, null as id, null as label, count(*) as n, null as type_place, null as st_place from r union all select 'type', type, null, null, null, count(*), type_place, null from r group by type, type_place
    union all select 'subtype', type, st, null, null, count(*), type_place, st_place from r where st is not null group by type, st, type_place, st_place union all select 'object', type, st, id, label, 1, type_place, st_place from r""")
)
def a2_taxonomy(spark, d) -> DataFrame:
    """The tree of types, subtypes and objects; two subtypes of parts have members, all else of parts and regions is unclassified."""
    nodes = all_nodes(spark, d).withColumn("st", F.col("sub"))
    defs = spark.createDataFrame([("main", "item", "PROMO", 0), ("main", "item", "ECONOMY", 1), ("main", "item", "UNUSED", 2), ("main", "reg", "x", 0)], "canvas_id string, type string, st string, ord int")
    return schema.taxonomy(nodes, defs, TYPE_ORDER).drop("canvas_id")


@query(g(", ev as (select src, dst from edges where rel = 'EVIDENCED_BY'), o as (select a.src as anchor, b.src as id, count(*) as shared from ev a join ev b on a.dst = b.dst and a.src <> b.src where a.src in (select id from nodes where label like 'blue%') group by all) select anchor, id, shared, row_number() over (partition by anchor order by shared desc, id) as place from o qualify place <= 5"))
def a4_evidence_overlap(spark, d) -> DataFrame:
    """For each anchor the five objects that share most documents with it."""
    gr = graph(spark, d)
    ev = gr.edges.where("rel = 'EVIDENCED_BY'").select("canvas_id", F.col("src").alias("id"), "dst")
    anchors = gr.nodes.where("label like 'blue%'").select("canvas_id", "id")
    own = ev.join(anchors, ["canvas_id", "id"], "left_semi").withColumnRenamed("id", "anchor")
    shared = own.join(ev, ["canvas_id", "dst"]).where("anchor <> id").groupBy("anchor", "id").agg(F.count("*").alias("shared"))
    place = Window.partitionBy("anchor").orderBy(F.desc("shared"), "id")
    return shared.withColumn("place", F.row_number().over(place)).where("place <= 5")


@query(g(", dg as (select n.id, n.type, n.label, count(e.id) as deg from nodes n left join (select src as id from edges union all select dst from edges) e on n.id = e.id where n.type = 'item' group by all) select type, lower(label) as fold, count(*) as n, min_by(id, (-deg, length(id), id)) as winner from dg group by type, lower(label) having count(*) >= 2"))
def a5_fold_groups(spark, d) -> DataFrame:
    """Groups of objects with one folded label, and who would survive a merge."""
    gr = graph(spark, d)
    rows = op.with_degree(gr.nodes.where("type = 'item'").select("canvas_id", "id", "type", "label"), gr.edges)
    return rows.groupBy("type", F.lower("label").alias("fold")).agg(F.count("*").alias("n"), F.min_by("id", op.degree_key(rows, gr.edges)).alias("winner")).where("n >= 2")


@query(g(", t as (select e.src, n.type, count(*) as n from edges e join nodes n on n.id = e.dst where e.src like 'F%' group by all) select src as id, string_agg(type || ' ' || n, ', ' order by n desc, type) as summary from t group by src"))
def a6_tally_text(spark, d) -> DataFrame:
    """What a failure mode is linked to, as one line."""
    gr = graph(spark, d)
    kinds = gr.nodes.select("canvas_id", F.col("id").alias("dst"), "type")
    n = gr.edges.where("src like 'F%'").join(kinds, ["canvas_id", "dst"]).groupBy("src", "type").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("type"), F.col("n"))))
    return n.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["type"], p["n"].cast("string"))), ", ").alias("summary"))


@query(g(" select canvas_id, dst as fm, list(substr(label, 1, 11) order by o) as marks from (select e.canvas_id, e.dst, p.label[1:11] as label, min(e.ord) as o from edges e join nodes p on p.id = e.src where e.rel = 'HAS_FAILURE' group by all) group by canvas_id, dst"))
def a7_ordered_distinct(spark, d) -> DataFrame:
    """Distinct labels of the parts of a failure mode, in order of first appearance."""
    gr = graph(spark, d)
    labels = gr.nodes.select("canvas_id", F.col("id").alias("src"), F.substring("label", 1, 11).alias("mark"))
    rows = gr.edges.where("rel = 'HAS_FAILURE'").join(labels, ["canvas_id", "src"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "mark"))), lambda x: x["mark"])
    return rows.groupBy("canvas_id", F.col("dst").alias("fm")).agg(F.array_distinct(ordered).alias("marks"))


@query(g(" select canvas_id, rel, count(distinct src) + count(distinct dst) as objects, count(*) as steps, count(distinct case when rel = 'EVIDENCED_BY' then dst end) as documents from edges group by canvas_id, rel"))
def a8_traversal_counts(spark, d) -> DataFrame:
    objects = F.count_distinct("src") + F.count_distinct("dst")
    docs = F.count_distinct(F.when(F.col("rel") == "EVIDENCED_BY", F.col("dst")))
    return all_edges(spark, d).groupBy("canvas_id", "rel").agg(objects.alias("objects"), F.count("*").alias("steps"), docs.alias("documents"))


@query(g(", dg as (select n.id, n.label, count(e.id) as degree from nodes n left join (select src as id from edges union all select dst from edges) e on n.id = e.id where n.type <> 'doc' group by all) select id, label, degree from dg order by degree desc, id limit 25"))
def k1_top_by_degree(spark, d) -> DataFrame:
    """The 25 most linked objects."""
    gr = graph(spark, d)
    rows = op.with_degree(gr.nodes.where("type <> 'doc'").select("canvas_id", "id", "label"), gr.edges)
    return rows.orderBy(F.desc("degree"), "id").limit(25).select("id", "label", "degree")


@query(
    g(""", seen as (select src as center, rel, dst as other, ord from edges union all select dst, rel, src, ord from edges),
    placed as (select center, rel, other, row_number() over (partition by center, rel order by ord, other) as place, count(*) over (partition by center, rel) as n,
      case when rel = 'EVIDENCED_BY' then 3 else 4 end as most from seen where center like 'F%')
    select center, rel, other, place, greatest(n - most, 0) as hidden from placed where place <= most""")
)
def k3_focus_caps(spark, d) -> DataFrame:
    """Neighbours shown around a center: at most four of a relation, three documents, and how many are hidden."""
    seen = op.both_ways(all_edges(spark, d)).select(F.col("id").alias("center"), "rel", "other", "ord").where("center like 'F%'")
    of = ["center", "rel"]
    place = F.row_number().over(Window.partitionBy(*of).orderBy("ord", "other"))
    proof = F.col("rel") == "EVIDENCED_BY"
    shown = seen.where(proof).withColumn("place", place).where("place <= 3").unionByName(seen.where(~proof).withColumn("place", place).where("place <= 4"))
    rows = shown.join(seen.groupBy(*of).agg(F.count("*").alias("n")), of)
    return rows.select("center", "rel", "other", "place", F.greatest(F.col("n") - F.when(proof, 3).otherwise(4), F.lit(0)).alias("hidden"))


@query(g(" select src, rel, dst, case when rel in ('HAS_FAILURE', 'CAUSED_BY') then 1 when rel = 'SIMILAR' and weight >= 0.8 then 1 when rel = 'SIMILAR' and weight >= 0.6 or rel in ('MITIGATED_BY', 'UNDER_REG') then 2 else 3 end as tier from edges where rel <> 'EVIDENCED_BY'"))
def k4_relevance_tier(spark, d) -> DataFrame:
    rel, weight = F.col("rel"), F.col("weight")
    tier = (
        F.when(rel.isin("HAS_FAILURE", "CAUSED_BY"), 1)
        .when((rel == "SIMILAR") & (weight >= 0.8), 1)
        .when(((rel == "SIMILAR") & (weight >= 0.6)) | rel.isin("MITIGATED_BY", "UNDER_REG"), 2)
        .otherwise(3)
    )
    return all_edges(spark, d).where("rel <> 'EVIDENCED_BY'").select("src", "rel", "dst", tier.alias("tier"))


@query(g(", s as (select src, dst, weight from edges where rel = 'SIMILAR') select src, dst, weight, rank() over (partition by substr(src, 3, 1) order by weight desc) as place from s qualify place = 1"))
def k5_top_tier(spark, d) -> DataFrame:
    """All that share the best score of their group."""
    rows = all_edges(spark, d).where("rel = 'SIMILAR'").select("src", "dst", "weight")
    place = Window.partitionBy(F.substring("src", 3, 1)).orderBy(F.desc("weight"))
    return rows.withColumn("place", F.rank().over(place)).where("place = 1")


@query(
    g(""" select fm, cause, rpn, s from (select e.dst as fm, c.dst as cause, (ascii(substr(e.src, length(e.src), 1)) % 10 + 1) * (11 - cast(substr(e.dst, 4, 1) as int)) as rpn, 10 - cast(substr(e.dst, 4, 1) as int) as s,
      row_number() over (partition by e.dst, c.dst order by (ascii(substr(e.src, length(e.src), 1)) % 10 + 1) * (11 - cast(substr(e.dst, 4, 1) as int)) desc, e.ord) as place
      from edges e join edges c on c.src = e.dst and c.rel = 'CAUSED_BY' where e.rel = 'HAS_FAILURE') where place = 1""")
)
def k8_best_per_key(spark, d) -> DataFrame:
    """Highest risk number of each failure mode and cause."""
    e = all_edges(spark, d)
    causes = e.where("rel = 'CAUSED_BY'").select("canvas_id", F.col("src").alias("fm"), F.col("dst").alias("cause"))
    digit = F.substring("fm", 4, 1).cast("int")
    rpn = (F.ascii(F.substring("src", -1, 1)) % 10 + 1) * (11 - digit)
    rows = e.where("rel = 'HAS_FAILURE'").withColumnRenamed("dst", "fm").join(causes, ["canvas_id", "fm"]).withColumns({"rpn": rpn, "s": 10 - digit})
    return op.first_per_key(rows, ["canvas_id", "fm", "cause"], F.desc("rpn"), "ord").select("fm", "cause", "rpn", "s")


@query(g(" select src, dst, row_number() over w as place, 1 - (row_number() over w - 1) * cast(0.01 as double) as score from edges where rel = 'OCCURRED_IN' window w as (partition by dst order by ord) qualify place <= 20"))
def k11_rank_decay(spark, d) -> DataFrame:
    """Scores that fall by 0.01 with each place."""
    place = F.row_number().over(Window.partitionBy("dst").orderBy("ord"))
    rows = all_edges(spark, d).where("rel = 'OCCURRED_IN'").select("src", "dst", place.alias("place")).where("place <= 20")
    return rows.withColumn("score", 1 - (F.col("place") - 1) * F.lit(0.01))


@query(
    g(""", a as (select id, label as v, ord from nodes where type in ('fm', 'cause')), b as (select id, id || '!' as v, ord + 9 as ord from nodes where type in ('cause', 'action')),
    u as (select * from a union all select * from b) select id, min(ord) as ord, max_by(v, ord) as v from u group by id""")
)
def u2_merge_views(spark, d) -> DataFrame:
    """Union of two views by id: place of the first, value of the last."""
    rows = all_nodes(spark, d).select("id", "type", F.col("label").alias("v"), "ord")
    more = rows.where("type in ('cause', 'action')").withColumns({"v": F.concat("id", F.lit("!")), "ord": F.col("ord") + 9})
    both = rows.where("type in ('fm', 'cause')").unionByName(more)
    return both.groupBy("id").agg(F.min("ord").alias("ord"), F.max_by("v", "ord").alias("v"))


@query(
    g(""", old as (select src, rel, dst from edges where rel in ('SIMILAR', 'CAUSED_BY')), new as (select src, rel, dst from edges where rel in ('SIMILAR', 'UNDER_REG') and (rel <> 'SIMILAR' or weight > 0.5))
    select 'removed' as change, src, rel, dst from (select * from old except select * from new) union all select 'added', src, rel, dst from (select * from new except select * from old)""")
)
def u7_snapshot_diff(spark, d) -> DataFrame:
    """Edges that one version of a graph lost and won against another."""
    e = all_edges(spark, d)
    key = ["src", "rel", "dst"]
    old = e.where("rel in ('SIMILAR', 'CAUSED_BY')").select(*key)
    new = e.where("rel = 'UNDER_REG' or rel = 'SIMILAR' and weight > 0.5").select(*key)
    change = lambda df, name: df.select(F.lit(name).alias("change"), *key)
    return change(old.join(new, key, "left_anti"), "removed").unionByName(change(new.join(old, key, "left_anti"), "added"))
