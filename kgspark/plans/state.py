"""Queries on the metamodel, canvases, guarded writes, the change log, entity upserts and the triple export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import canvases as cv
from kgspark.operators import merge as mg
from kgspark.operators import schema as sc
from kgspark.operators import seed, triples
from kgspark.operators.lineage import shared_folder
from kgspark.sources.tables import graph, table
from kgspark.sources.tables import nodes as all_nodes

from .graph import g
from .registry import query

c = F.col


# nodes with subtypes: items of nations and suppliers, and failure modes by their line status
_TYPED = """, typed as (select canvas_id, id, type, label, case when id like 'IN%' then 'nation' when id like 'IS%' then 'supplier' when type = 'fm' then substr(id, 3, 1) end as st, props from nodes),
 ot as (select distinct canvas_id, type as type_id, 'type ' || type as label, case when type in ('item', 'fm') then 'about ' || type else '' end as description from typed),
 rt as (select e.canvas_id, rel as rel_id, 'relation ' || rel as label, list_sort(list(distinct a.type)) as src_types, case when rel = 'EVIDENCED_BY' then [] else list_sort(list(distinct b.type)) end as dst_types
   from edges e join typed a on a.id = e.src join typed b on b.id = e.dst group by e.canvas_id, rel),
 st as (select distinct canvas_id, type as type_id, st as st_id, 'kind ' || st as label from typed where st is not null and st <> 'supplier'),
 pd as (select distinct canvas_id, type as type_id, p.k as key, 'property ' || p.k as label, case when p.k in ('material', 'market', 'segment') then 'text' else 'number' end as datatype from (select canvas_id, type, unnest(props) as p from typed))"""


def typed_graph(spark, d):
    """The graph with subtypes, and its metamodel."""
    gr = graph(spark, d)
    kind = F.when(c("id").startswith("IN"), "nation").when(c("id").startswith("IS"), "supplier").when(c("type") == "fm", F.substring("id", 3, 1))
    nodes = gr.nodes.withColumn("st", kind)
    about = F.when(c("type_id").isin("item", "fm"), F.concat(F.lit("about "), "type_id")).otherwise("")
    types = nodes.select("canvas_id", c("type").alias("type_id")).distinct().withColumn("label", F.concat(F.lit("type "), "type_id")).withColumn("description", about)
    end = lambda name: nodes.select("canvas_id", c("id").alias(name), c("type").alias(f"{name}_type"))
    rels = gr.edges.join(end("src"), ["canvas_id", "src"]).join(end("dst"), ["canvas_id", "dst"]).groupBy("canvas_id", c("rel").alias("rel_id"))
    rels = rels.agg(F.array_sort(F.collect_set("src_type")).alias("src_types"), F.array_sort(F.collect_set("dst_type")).alias("dst_types"))
    none = F.array().cast("array<string>")
    rels = rels.select("canvas_id", "rel_id", F.concat(F.lit("relation "), "rel_id").alias("label"), "src_types", F.when(c("rel_id") == "EVIDENCED_BY", none).otherwise(c("dst_types")).alias("dst_types"))
    subs = nodes.where("st is not null and st <> 'supplier'").select("canvas_id", c("type").alias("type_id"), c("st").alias("st_id")).distinct()
    subs = subs.withColumn("label", F.concat(F.lit("kind "), "st_id")).withColumn("keywords", F.array(F.lower("st_id")))
    defs = nodes.select("canvas_id", c("type").alias("type_id"), F.explode("props.k").alias("key")).distinct().withColumn("label", F.concat(F.lit("property "), "key"))
    defs = defs.withColumn("datatype", F.when(c("key").isin("material", "market", "segment"), "text").otherwise("number"))
    return nodes, gr.edges, sc.Metamodel(types, rels, subs, defs)


@query(
    g(_TYPED + """ select 'type' as what, type_id as name, description as detail from ot union all select 'relation', rel_id, array_to_string(src_types, ',') || '>' || array_to_string(dst_types, ',') from rt
    union all select 'subtype', type_id || '_' || st_id, label from st union all select 'property', type_id || '.' || key, datatype from pd""")
)
def s2_metamodel(spark, d) -> DataFrame:
    """The four tables of a metamodel, written for two canvases and read for one."""
    _, _, model = typed_graph(spark, d)
    other = lambda df: df.unionByName(df.withColumn("canvas_id", F.lit("other")))
    path = f"{shared_folder(spark)}/metamodel-{uuid.uuid4().hex}"
    sc.save_metamodel(sc.Metamodel(*(other(df) for df in (model.object_types, model.relation_types, model.subtypes, model.property_defs))), path)
    m = sc.load_metamodel(spark, path, "main")
    told = lambda df, what, name, detail: df.select(F.lit(what).alias("what"), name.alias("name"), detail.alias("detail"))
    ends = F.concat_ws(">", F.concat_ws(",", "src_types"), F.concat_ws(",", "dst_types"))
    return (
        told(m.object_types, "type", c("type_id"), c("description"))
        .unionByName(told(m.relation_types, "relation", c("rel_id"), ends))
        .unionByName(told(m.subtypes, "subtype", F.concat_ws("_", "type_id", "st_id"), c("label")))
        .unionByName(told(m.property_defs, "property", F.concat_ws(".", "type_id", "key"), c("datatype")))
    )


_URI = "'{0}:' || replace(replace(replace(url_encode({1}), '+', '%20'), '~', '%7E'), '*', '%2A')"
_CLASS, _SUB, _REL, _PROP = _URI.format("class", "type_id"), _URI.format("class", "type_id || '_' || st_id"), _URI.format("rel", "rel_id"), _URI.format("prop", "key")


@query(
    g(_TYPED + f""", t as (
    select {_CLASS} as subject, 'rdf:type' as predicate, 'rdfs:Class' as object from ot union all select {_CLASS}, 'rdfs:label', '"' || label || '"' from ot
    union all select {_CLASS}, 'rdfs:comment', '"' || description || '"' from ot where description <> ''
    union all select {_SUB}, 'rdf:type', 'rdfs:Class' from st union all select {_SUB}, 'rdfs:subClassOf', {_CLASS} from st union all select {_SUB}, 'rdfs:label', '"' || label || '"' from st
    union all select {_REL}, 'rdf:type', 'rdf:Property' from rt union all select {_REL}, 'rdfs:label', '"' || label || '"' from rt
    union all select {_REL}, 'rdfs:domain', 'class:' || src_types[1] from rt where len(src_types) > 0 union all select {_REL}, 'rdfs:range', 'class:' || dst_types[1] from rt where len(dst_types) > 0
    union all select {_PROP}, 'rdf:type', 'rdf:Property' from pd union all select {_PROP}, 'rdfs:domain', {_CLASS} from pd union all select {_PROP}, 'rdfs:label', '"' || label || '"' from pd
    union all select {_PROP}, 'rdfs:range', case when datatype = 'number' then 'xsd:decimal' else 'xsd:string' end from pd
    union all select {_URI.format('node', 'id')}, 'rdf:type', case when (type, st) in (select (type_id, st_id) from st) then 'class:' || type || '_' || st else 'class:' || type end from typed
    union all select {_URI.format('node', 'id')}, 'rdfs:label', '"' || label || '"' from typed
    union all select {_URI.format('node', 'id')}, {_URI.format('prop', 'p.k')}, '"' || p.v || '"' || case when regexp_full_match(trim(p.v), '-?[0-9]+([.][0-9]+)?') then '^^xsd:decimal' else '' end from (select id, unnest(props) as p from typed)
    union all select {_URI.format('node', 'src')}, {_URI.format('rel', 'rel')}, {_URI.format('node', 'dst')} from edges)
    select distinct * from t""")
)
def w19_triples(spark, d) -> DataFrame:
    """Schema and graph as triples."""
    return triples.triples(*typed_graph(spark, d))


@query(
    """with core as (select 'PJ' || c_custkey as src, case when c_custkey % 3 = 0 then 'SIMILAR 0.' || (c_custkey % 90 + 10) else 'TARGET_MARKET' end as rel, 'R' || (c_custkey % 5) as dst, c_custkey as ord from customer),
    rules as (select 'PJ' || c_custkey as parent, c_custkey % 4 as n, c_custkey as ord from customer),
    numbered as (select parent, ord, i, row_number() over (order by ord, i) - 1 as k from (select parent, ord, unnest(generate_series(0, n - 1)) as i from rules))
    select src, case when rel like 'SIMILAR %' then 'SIMILAR' else rel end as rel, dst, try_cast(regexp_extract(rel, '^SIMILAR ([0-9.]+)$', 1) as double) as weight from core
    union all select parent, 'EVIDENCED_BY', 'D' || k || '.' || case i % 2 when 0 then 'xlsx' else 'pdf' end, null from numbered"""
)
def s14_seed_graph(spark, d) -> DataFrame:
    """A seed graph: weights out of relation names, and numbered documents around its objects."""
    key = c("c_custkey")
    rel = F.when(key % 3 == 0, F.concat(F.lit("SIMILAR 0."), (key % 90 + 10).cast("string"))).otherwise("TARGET_MARKET")
    rows = table(spark, d, "customer").select(F.concat(F.lit("PJ"), key).alias("src"), rel.alias("rel"), F.concat(F.lit("R"), key % 5).alias("dst"), key.alias("ord"))
    core = seed.weights_from_names(rows).select("src", "rel", "dst", "weight")
    rules = table(spark, d, "customer").select(F.concat(F.lit("PJ"), key).alias("parent"), (key % 4).cast("int").alias("n"), F.array(F.lit("xlsx"), F.lit("pdf")).alias("kinds"), key.alias("ord"))
    nodes, links = seed.satellites(rules)
    named = links.join(nodes.select(c("id").alias("dst"), "sub"), "dst").select("src", "rel", F.concat_ws(".", "dst", "sub").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return core.unionByName(named)


@query(
    """select src, rel, dst, try_cast(regexp_extract(rel, 'SIMILAR ([0-9.]+)', 1) as double) as weight from (
    select 'PJ' || c_custkey as src, case when c_custkey % 3 = 0 then 'SIMILAR 0.' || (c_custkey % 90 + 10) else 'TARGET_MARKET' end as rel, 'R' || (c_custkey % 5) as dst from customer)"""
)
def s14_weight_in_relation(spark, d) -> DataFrame:
    """Weights written into relation names."""
    key = c("c_custkey")
    rel = F.when(key % 3 == 0, F.concat(F.lit("SIMILAR 0."), (key % 90 + 10).cast("string"))).otherwise("TARGET_MARKET")
    rows = table(spark, d, "customer").select(F.concat(F.lit("PJ"), key).alias("src"), rel.alias("name"), F.concat(F.lit("R"), key % 5).alias("dst"))
    return seed.weights_from_names(rows.withColumn("rel", c("name"))).select("src", c("name").alias("rel"), "dst", "weight")


@query(g(", defs as (select unnest(['item', 'fm', 'cause', 'drawing', 'master']) as type_id) select 'main' as canvas_id, type_id from defs where type_id not in (select type from nodes)"))
def w12_unused_types(spark, d) -> DataFrame:
    """Object types that may be deleted."""
    defs = spark.createDataFrame([("main", t) for t in ("item", "fm", "cause", "drawing", "master")], "canvas_id string, type_id string")
    none = spark.createDataFrame([], "canvas_id string, type_id string, st_id string, key string")
    _, told = sc.delete_types(sc.Metamodel(defs, none, none, none), defs, all_nodes(spark, d))
    return told.where("uses = 0").select("canvas_id", "type_id")


def canvas_table(spark, d) -> DataFrame:
    """Every customer's canvas, every fifth of them in the trash."""
    key = c("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), key).alias("canvas_id"), c("c_name").alias("name"), c("c_mktsegment").alias("description"), key.cast("long").alias("created"), F.when(key % 5 == 0, key + 10**6).cast("long").alias("deleted")
    )


_CANVASES = "with cv as (select 'c' || c_custkey as canvas_id, c_custkey as k, c_custkey % 5 = 0 as trash from customer)"


@query(_CANVASES + """ select 'active' as view, canvas_id, (select count(*) from orders where o_custkey = k) as nodes, (select count(*) from events where user_id = k) as sources from cv where not trash
  union all select 'trash', canvas_id, (select count(*) from orders where o_custkey = k), (select count(*) from events where user_id = k) from cv where trash""")
def s15_canvas_list(spark, d) -> DataFrame:
    """Canvases and the trash with what they hold: orders as nodes, events as sources."""
    nodes = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("canvas_id"))
    sources = table(spark, d, "events").select(F.concat(F.lit("c"), "user_id").alias("canvas_id"))
    rows = canvas_table(spark, d)
    view = lambda name: cv.listed(rows, nodes, sources, name == "trash").select(F.lit(name).alias("view"), "canvas_id", "nodes", "sources")
    return view("active").unionByName(view("trash"))


@query(
    """with named as (select c_custkey as ord, case when c_custkey % 4 = 0 then '  ' || c_mktsegment || ' Größe №' || c_nationkey || '! ' else '--' end as name from customer),
    based as (select name, ord, case when s = '' then 'canvas' else s end as slug from (select *, regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as s from named)),
    taken as (select 1 as i union select 2 union select 5), placed as (select *, row_number() over (partition by slug order by ord) as place from based),
    free as (select i, row_number() over (order by i) as place from (select unnest(generate_series(1, (select count(*) + 5 from customer))) as i) where i not in (select i from taken))
    select name, ord, case when slug <> 'canvas' then case when p.place > 1 then slug || '-' || p.place else slug end else slug || '-' || free.i end as slug from placed p left join free on free.place = p.place"""
)
def w13_unique_slugs(spark, d) -> DataFrame:
    """New canvases for all customers, three of four under one name of which three numbers are taken."""
    key = c("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" Größe №"), "c_nationkey", F.lit("! "))).otherwise("--")
    taken = spark.createDataFrame([("canvas",), ("canvas-2",), ("canvas-5",)], "canvas_id string")
    return cv.unique_slugs(table(spark, d, "customer").select(name.alias("name"), key.alias("ord")), taken)


@query(
    _CANVASES + """, renamed as (select *, case when k % 7 = 0 then 'new ' || k end as name from cv), trashed as (select *, trash or k % 2 = 0 as gone from renamed), back as (select *, gone and k % 6 <> 0 as away from trashed)
    select canvas_id, coalesce(name, (select c_name from customer where c_custkey = k)) as name, away as deleted,
      case when k % 3 <> 0 then 'not asked' when away then 'purged' else 'active' end as verdict from back"""
)
def w13_canvas_changes(spark, d) -> DataFrame:
    """Canvases renamed, put into the trash, restored and purged in turn."""
    rows, key = canvas_table(spark, d), F.substring("canvas_id", 2, 30).cast("long")
    asked = lambda by: rows.where(key % by == 0).select("canvas_id", key.alias("ord"))
    rows2 = cv.rename(rows, asked(7).select("canvas_id", F.concat(F.lit(" new "), key.cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), "ord"))
    rows3, _ = cv.trash(rows2, asked(2))
    rows4 = cv.restore(rows3, asked(6))
    _, _, told = cv.purge(rows4, asked(3), [])
    return rows4.join(told.drop("ord"), "canvas_id", "left").select("canvas_id", "name", c("deleted").isNotNull().alias("deleted"), F.coalesce("verdict", F.lit("not asked")).alias("verdict"))


@query(
    g(""", asked as (select id, cast(substr(id, 2) as bigint) as k from nodes where type = 'doc'),
    told as (select id, k, case when k % 5 = 0 then 0 else 2 end as objects, case when k % 3 = 0 then 'renamed file' when k % 5 = 0 then 'empty extraction' else 'replaced' end as verdict from asked),
    done as (select id from told where verdict = 'replaced'), ev as (select src, count(distinct dst) as n, count(distinct dst) filter (where dst in (select id from done)) as hits from edges where rel = 'EVIDENCED_BY' group by src),
    gone as (select id from done union select src from ev where n = hits), kept as (select src, rel, dst from edges where src not in (select id from gone) and dst not in (select id from gone)),
    fresh as (select 'X' || k || '_' || i as src, id as dst from told, (select unnest([0, 1]) as i) where verdict = 'replaced')
    select src, rel, dst from kept where rel = 'EVIDENCED_BY' union all select src, 'EVIDENCED_BY', dst from fresh""")
)
def w8_replace_document(spark, d) -> DataFrame:
    """Evidence after every document came in anew: another file name or no objects and it stays, else its old objects go and two new ones come."""
    gr = graph(spark, d)
    number = F.substring("id", 2, 30).cast("long")
    docs = gr.nodes.where("type = 'doc'")
    asked = docs.select("canvas_id", "id", c("label").alias("file"), F.when(number % 3 == 0, F.concat("label", F.lit("x"))).otherwise(c("label")).alias("new_file"))
    found = docs.where(number % 5 != 0).withColumn("k", number).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    objects = found.select("canvas_id", F.format_string("X%d_%d", "k", "i").alias("id"), F.lit("item").alias("type"), "label", "sub", "st", "props", (c("ord") * 2 + c("i")).alias("ord"), c("id").alias("doc"))
    # the document itself comes in again with its objects
    new_nodes = objects.unionByName(docs.withColumn("doc", c("id")))
    new_edges = found.select("canvas_id", F.format_string("X%d_%d", "k", "i").alias("src"), F.lit("EVIDENCED_BY").alias("rel"), c("id").alias("dst"), F.lit(None).cast("double").alias("weight"), "ord", c("id").alias("doc"))
    _, edges, _ = mg.replace_documents(gr.nodes, gr.edges, asked, new_nodes, new_edges)
    return edges.where("rel = 'EVIDENCED_BY'").select("src", "rel", "dst")


@query(
    """with u as (select page_id as ord, case when page_id % 7 = 0 then 'untyped' else 'main' end as canvas_id, regexp_extract(url, '^https?://([^/]+)', 1) || page_id % 50 || case page_id % 4 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.xlsx' else '.exe' end as file, case when page_id % 11 = 0 then 0 else length(html) end as size from pages),
    known as (select regexp_extract(url, '^https?://([^/]+)', 1) || page_id % 50 || '.pdf' as file from pages where page_id % 8 = 0),
    r as (select *, case when canvas_id = 'untyped' then 'no object types' when not regexp_matches(file, '(?i)[.](xlsx|pptx|docx|dxf|pdf)$') then 'kind of file' when size = 0 then 'empty file' when size > 3000 then 'too large' when file in (select file from known) then 'duplicate name' end as reason from u)
    select ord, file, coalesce(reason, case when row_number() over (partition by canvas_id, file, reason order by ord) > 1 then 'duplicate name' else 'accepted' end) as verdict from r"""
)
def w9_upload_guards(spark, d) -> DataFrame:
    """What becomes of uploads of all pages under made names."""
    key, host = c("page_id"), F.regexp_extract("url", "^https?://([^/]+)", 1)
    ending = F.when(key % 4 == 0, ".pdf").when(key % 4 == 1, ".DOCX").when(key % 4 == 2, ".xlsx").otherwise(".exe")
    file = F.concat(host, (key % 50).cast("string"))
    pages = table(spark, d, "pages")
    uploads = pages.select(F.when(key % 7 == 0, "untyped").otherwise("main").alias("canvas_id"), F.concat(file, ending).alias("file"), F.when(key % 11 == 0, 0).otherwise(F.length("html")).alias("size"), key.alias("ord"))
    sources = pages.where("page_id % 8 = 0").select(F.lit("main").alias("canvas_id"), F.concat(file, F.lit(".pdf")).alias("file"))
    types = spark.createDataFrame([("main", "item")], "canvas_id string, type_id string")
    good, refused = mg.guarded_uploads(uploads, sources, types, most=3000)
    return good.select("ord", "file", F.lit("accepted").alias("verdict")).unionByName(refused.select("ord", "file", c("reason").alias("verdict")))


@query(
    g(_TYPED + """, asked as (select type_id from ot union select 'ghost'), defs as (select canvas_id, type_id, label from ot where type_id <> 'fm' union all select 'main', 'fm', 'renamed' union all select 'main', x, 'added ' || x from (select distinct c_mktsegment as x from customer))
    select defs.type_id, label, (select count(*) from nodes n where n.type = defs.type_id) as uses, (select count(*) from nodes n where n.type = defs.type_id) > 0 as stays from defs""")
)
def w12_type_changes(spark, d) -> DataFrame:
    """Object types with one renamed and some added; then all are to go, and those in use stay."""
    nodes, _, model = typed_graph(spark, d)
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    added = segments.select(F.lit("main").alias("canvas_id"), c("c_mktsegment").alias("type_id"), F.concat(F.lit("added "), "c_mktsegment").alias("label"), F.lit("").alias("description"), F.lit(1).alias("ord"))
    twice = spark.createDataFrame([("main", "fm", "first", "", 1), ("main", "fm", "renamed", "", 2)], "canvas_id string, type_id string, label string, description string, ord int")
    types = sc.upsert_types(model.object_types, added.unionByName(twice), "object_types")
    model = sc.Metamodel(types, model.relation_types, model.subtypes, model.property_defs)
    left, told = sc.delete_types(model, types.select("canvas_id", "type_id").unionByName(spark.createDataFrame([("main", "ghost")], "canvas_id string, type_id string")), nodes)
    stays = left.object_types.select("type_id", F.lit(True).alias("stays"))
    return types.join(told.select("type_id", "uses"), "type_id").join(stays, "type_id", "left").select("type_id", "label", "uses", F.coalesce("stays", F.lit(False)).alias("stays"))


@query(
    """with r as (select distinct event_type as op, date_trunc('hour', ts) as "at", 'U' || user_id as id from events), n as (select *, row_number() over (partition by op, "at" order by id) as n, count(*) over (partition by op, "at") as ids from r)
    select op, "at", max(ids) as ids, op || ': ' || string_agg(id, ', ' order by n) filter (where n <= 5) || case when max(ids) > 5 then ' and ' || (max(ids) - 5) || ' more' else '' end as summary from n group by op, "at\""""
)
def w14_change_log(spark, d) -> DataFrame:
    """Events by the hour, appended to a change log in two batches and read again."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    changes = table(spark, d, "events").select(F.lit("main").alias("canvas_id"), c("event_type").alias("op"), F.date_trunc("hour", "ts").alias("at"), F.concat(F.lit("U"), "user_id").alias("id"))
    mg.append_log(changes.where("hour(at) < 12"), path)
    mg.append_log(changes.where("hour(at) >= 12"), path)
    return spark.read.parquet(path).select("op", c("at").cast("timestamp_ntz").alias("at"), "ids", "summary")


_ENTITIES = """with ev as (select user_id, event_id, event_type, value, cast(json_extract(props, '$.k') as int) as k from events),
 old as (select c_custkey as id, c_name as name, c_mktsegment as type, 'a' as k, c_name as v, c_custkey % 2 = 0 as vector from customer)"""


@query(
    _ENTITIES + """, p as (select user_id as id, 'k' || k % 5 as k, max_by(event_type, event_id) as v from ev group by 1, 2 union all select id, k, v from old where id in (select user_id from ev)),
    last as (select user_id as id, max_by(event_type, event_id) as name, max(event_id) as at, max(event_id) filter (where event_id % 3 = 0) as sized from ev group by user_id)
    select id, name, 'event' as type, (select array_to_string(list_sort(list(k || '=' || v)), ';') from p where p.id = last.id) as props, case when sized is not null then sized when id in (select id from old where vector) then -1 end as vector from last
    union all select id, name, type, k || '=' || v, case when vector then -1 end from old where id not in (select user_id from ev)"""
)
def w16_entity_upsert(spark, d) -> DataFrame:
    """Customers as entities, events as their changes; of the events' vectors every third has the right size."""
    cust, ev = table(spark, d, "customer"), table(spark, d, "events")
    vector = lambda first: F.array(first.cast("float"), F.lit(0.0).cast("float"))
    old = cust.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("type"), F.create_map(F.lit("a"), "c_name").alias("props"), F.when(c("c_custkey") % 2 == 0, vector(F.lit(-1))).alias("embedding"))
    key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    # sizes of 2 fit; the id stands in the vector
    sized = F.when(c("event_id") % 3 == 0, vector(c("event_id"))).when(c("event_id") % 3 == 1, F.array(F.lit(9.0).cast("float")))
    new = ev.select(c("user_id").alias("id"), c("event_type").alias("name"), F.lit("event").alias("type"), F.create_map(key, c("event_type")).alias("props"), sized.alias("embedding"), c("event_id").alias("ord"))
    out = mg.upsert_entities(old, new, 2)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("id", "name", "type", listed.alias("props"), c("embedding")[0].cast("long").alias("vector"))


@query(
    _ENTITIES + """, n as (select user_id as src, event_type as type, user_id % 10 as dst, event_id, case when event_id % 4 <> 0 then value end as weight, k from ev where user_id in (select id from old) and user_id % 10 in (select id from old)),
    o as (select distinct user_id as src, 'click' as type, user_id % 10 as dst, 0.5::double as weight from ev where user_id % 2 = 0)
    select src, type, dst, coalesce(max_by(weight, event_id) filter (where weight is not null), (select weight from o where (o.src, o.type, o.dst) = (n.src, n.type, n.dst))) as weight,
      count(distinct k % 5) + case when (src, type, dst) in (select (src, type, dst) from o) then 1 else 0 end as props from n group by src, type, dst
    union all select src, type, dst, weight, 1 from o where (src, type, dst) not in (select (src, type, dst) from n)"""
)
def w17_relation_upsert(spark, d) -> DataFrame:
    """Events as relations between customers, both of whom must be there; weights and properties of earlier ones stay where none is given."""
    ev = table(spark, d, "events")
    entities = table(spark, d, "customer").select(c("c_custkey").alias("id"))
    key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    new = ev.select(c("user_id").alias("src"), c("event_type").alias("type"), (c("user_id") % 10).alias("dst"), F.when(c("event_id") % 4 != 0, c("value")).alias("weight"), F.create_map(key, c("event_type")).alias("props"), c("event_id").alias("ord"))
    old = ev.where("user_id % 2 = 0").select(c("user_id").alias("src"), F.lit("click").alias("type"), (c("user_id") % 10).alias("dst"), F.lit(0.5).alias("weight"), F.create_map(F.lit("old"), F.lit("x")).alias("props")).dropDuplicates(["src", "dst"])
    out = mg.upsert_relations(old, new, entities)
    return out.select("src", "type", "dst", "weight", F.size("props").cast("long").alias("props"))
