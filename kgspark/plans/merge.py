"""Queries on merges, deletes and upserts.

Increments are derived from the graph: every third project and its edges count as old state, an overlapping part
of it as the new batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import graph as op
from kgspark.operators import merge as mg
from kgspark.sources.tables import graph, table
from kgspark.sources.tables import edges as all_edges
from kgspark.sources.tables import nodes as all_nodes

from .graph import g
from .registry import query

# old state: objects whose ord is not a multiple of 3; the batch: those whose ord is not 1 modulo 3
_SPLIT = """, old_nodes as (select * from nodes where ord % 3 <> 0), new_nodes as (select * from nodes where ord % 3 <> 1),
 old_edges as (select * from edges where ord % 3 <> 0 and src in (select id from old_nodes) and dst in (select id from old_nodes)),
 new_edges as (select * from edges where ord % 2 = 0),
 known as (select id from nodes),
 added_nodes as (select * from new_nodes where id not in (select id from old_nodes)),
 added_edges as (select * from new_edges n where (src, rel, dst) not in (select src, rel, dst from old_edges) and src in (select id from known) and dst in (select id from known))"""


def split(spark, d):
    gr = graph(spark, d)
    old = gr.nodes.where("ord % 3 <> 0")
    old_edges = gr.edges.where("ord % 3 <> 0").join(op.ids(old, "src"), ["canvas_id", "src"], "left_semi").join(op.ids(old, "dst"), ["canvas_id", "dst"], "left_semi")
    return old, old_edges.select(*gr.edges.columns), gr.nodes.where("ord % 3 <> 1"), gr.edges.where("ord % 2 = 0")


@query(g(_SPLIT + " select id, type, label, ord from old_nodes union all select id, type, label, ord from added_nodes"))
def w1_insert_if_absent(spark, d) -> DataFrame:
    old, _, new, _ = split(spark, d)
    return mg.insert_if_absent(old, new, mg.NODE).select("id", "type", "label", "ord")


@query(
    g(_SPLIT + """ select 'node' as what, id, cast(null as varchar) as rel, cast(null as varchar) as dst from added_nodes
    union all select 'edge', src, rel, dst from added_edges
    union all select distinct 'touched', id, null, null from (select src as id from added_edges union all select dst from added_edges) where id not in (select id from added_nodes)""")
)
def w2_merge_delta(spark, d) -> DataFrame:
    """What a batch adds, and which old objects it touches."""
    delta = mg.merge_delta(*split(spark, d))
    none = F.lit(None).cast("string")
    node = delta.nodes.select(F.lit("node").alias("what"), "id", none.alias("rel"), none.alias("dst"))
    edge = delta.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "rel", "dst")
    return node.unionByName(edge).unionByName(delta.touched.select(F.lit("touched").alias("what"), "id", none.alias("rel"), none.alias("dst")))


KNOWN_RELATIONS = ["CONSISTS_OF", "HAS_FAILURE", "CAUSED_BY", "SIMILAR"]


@query(g(" select distinct canvas_id, rel as rel_id, cast([] as varchar[]) as src_types, cast([] as varchar[]) as dst_types from edges where rel not in ('CONSISTS_OF', 'HAS_FAILURE', 'CAUSED_BY', 'SIMILAR')"))
def w3_register_relations(spark, d) -> DataFrame:
    known = spark.createDataFrame([("main", r) for r in KNOWN_RELATIONS], "canvas_id string, rel_id string")
    return mg.unseen_relations(all_edges(spark, d), F.broadcast(known))


@query(g(", gone as (select id from nodes where type = 'proj' and ord % 5 = 0) select src, rel, dst from edges where src not in (select id from gone) and dst not in (select id from gone)"))
def w4_delete_cascade(spark, d) -> DataFrame:
    """Edges left when every fifth project goes."""
    gr = graph(spark, d)
    _, left = mg.delete_nodes(gr.nodes, gr.edges, gr.nodes.where("type = 'proj' and ord % 5 = 0"))
    return left.select("src", "rel", "dst")


@query(g(" select src, rel, dst from edges where rel = 'SIMILAR' and (src, rel, dst) not in (select src, rel, dst from edges where weight < 0.5)"))
def w5_delete_edges(spark, d) -> DataFrame:
    e = all_edges(spark, d)
    return e.where("rel = 'SIMILAR'").join(e.where("weight < 0.5").select(*op.KEY), op.KEY, "left_anti").select("src", "rel", "dst")


_PAIRS = """, dg as (select n.id, n.label, count(x.i) as deg from nodes n left join (select src as i from edges union all select dst from edges) x on x.i = n.id where n.id like 'IP%' group by n.id, n.label),
 won as (select id, first_value(id) over (partition by label order by deg desc, length(id), id) as into_id from dg), pairs as (select id, into_id from won where id <> into_id)"""


@query(
    g(_PAIRS + """, moved as (select coalesce(a.into_id, e.src) as src, e.rel, coalesce(b.into_id, e.dst) as dst, e.ord from edges e left join pairs a on a.id = e.src left join pairs b on b.id = e.dst)
    select src, rel, dst, min(ord) as ord from moved where src <> dst group by src, rel, dst""")
)
def w6_merge_edges(spark, d) -> DataFrame:
    """Edges after all parts with one name are merged into one."""
    gr = graph(spark, d)
    parts = gr.nodes.where("id like 'IP%'")
    _, left = mg.merge_nodes(parts, gr.edges, mg.survivors(parts, gr.edges, F.col("label")), "merged")
    return left.select("src", "rel", "dst", "ord")


@query(g(_PAIRS + " select n.id, n.label, 3 + (select count(*) from pairs p where p.into_id = n.id) as props from nodes n where n.id like 'IP%' and n.id not in (select id from pairs)"))
def w6_merge_nodes(spark, d) -> DataFrame:
    """Surviving parts and how many properties they have, lost labels among them."""
    gr = graph(spark, d)
    parts = gr.nodes.where("id like 'IP%'")
    left, _ = mg.merge_nodes(parts, gr.edges, mg.survivors(parts, gr.edges, F.col("label")), "merged")
    return left.select("id", "label", F.size("props").cast("long").alias("props"))


@query(
    g(""", gone as (select id from nodes where type = 'doc' and ord % 2 = 0), ev as (select src, count(*) as n, count(*) filter (where dst in (select id from gone)) as hits from edges where rel = 'EVIDENCED_BY' group by src)
    select src as id, case when n = hits then 'gone' else 'kept' end as fate from ev where hits > 0""")
)
def w7_delete_documents(spark, d) -> DataFrame:
    """Fate of the objects behind every second document."""
    gr = graph(spark, d)
    _, _, fate = mg.delete_documents(gr.nodes, gr.edges, gr.nodes.where("type = 'doc' and ord % 2 = 0"))
    return fate.select("id", "fate")


@query("select doc_id, case when doc_id % 3 = 0 then 'kind2' else source end as kind, case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'new' else lang end as content from documents")
def w10_source_upsert(spark, d) -> DataFrame:
    """Registry rows replaced by later ones, content kept where the later one has none."""
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), F.col("lang").alias("content"), F.col("doc_id").alias("ord"))
    new = old.where("doc_id % 3 = 0").select("doc_id", F.lit("kind2").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "new").alias("content"), "ord")
    return mg.upsert(old, new, ["doc_id"], keep_if_null=("content",)).drop("ord")


@query("select conv_id, turn, role from conversations where conv_id % 4 <> 0 union all select conv_id, turn, 'redone' from conversations where conv_id % 4 = 0 and turn = 0")
def w11_replace_chunks(spark, d) -> DataFrame:
    """All turns of every fourth conversation replaced by one."""
    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = old.where("conv_id % 4 = 0 and turn = 0").withColumn("role", F.lit("redone"))
    return mg.replace_rows(old, new, ["conv_id"])


@query(
    g(""", old as (select dst as doc, src as id from edges where rel = 'EVIDENCED_BY'), fresh as (select distinct doc, 'F' || 'RF' || (1 + cast(substr(doc, 2) as bigint) % 5) as id from old where cast(substr(doc, 2) as bigint) % 3 = 0)
    select doc, id from old where doc not in (select doc from fresh where id in (select id from nodes)) union all select doc, id from fresh where id in (select id from nodes)""")
)
def w18_replace_mentions(spark, d) -> DataFrame:
    """Mentions of every third document replaced; a document without new ids keeps its own."""
    gr = graph(spark, d)
    old = gr.edges.where("rel = 'EVIDENCED_BY'").select(F.col("dst").alias("doc"), F.col("src").alias("id"))
    number = F.substring("doc", 2, 30).cast("long")
    fresh = old.where(number % 3 == 0).select("doc", F.concat(F.lit("FRF"), (1 + number % 5).cast("string")).alias("id")).distinct()
    return mg.replace_rows(old, fresh.join(gr.nodes.select("id"), "id", "left_semi").select("doc", "id"), ["doc"])


@query("with r as (select user_id % 3 as canvas, event_type as key, event_id, value from events) select canvas, key, max_by(value, event_id) as value from r group by canvas, key")
def w21_key_values(spark, d) -> DataFrame:
    """Latest value of each key of a canvas."""
    rows = table(spark, d, "events").select((F.col("user_id") % 3).alias("canvas"), F.col("event_type").alias("key"), "event_id", "value")
    return rows.groupBy("canvas", "key").agg(F.max_by("value", "event_id").alias("value"))
