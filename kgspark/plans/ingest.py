"""Queries on ingestion, drawings and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ingest as ing
from kgspark.operators import office
from kgspark.operators.lineage import shared_folder
from kgspark.sources import documents as src
from kgspark.sources.tables import table
from kgspark.streaming import changes

from .registry import query

c = F.col


def vocabulary(spark, d) -> DataFrame:
    """Part names as terms; the first word is a synonym, the name's initials a code."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    words = F.split("p_name", " ")
    code = F.concat(F.lit("X-"), F.substring(words[0], 1, 2), F.substring(words[1], 1, 2))
    return names.select(F.concat(F.lit("V"), c("ord").cast("string")).alias("id"), c("p_name").alias("label"), F.array(code).alias("codes"), F.array(words[0]).alias("synonyms"), "ord")


_VOC = """with voc as (select 'V' || min(p_partkey) as id, p_name as label, 'X-' || substr(split_part(p_name, ' ', 1), 1, 2) || substr(split_part(p_name, ' ', 2), 1, 2) as code, split_part(p_name, ' ', 1) as syn, min(p_partkey) as ord from part group by p_name),
 k as (select lower(id) as key, id, 'id' as way, 1.0::double as confidence, 0 as rank, ord from voc union all select replace(label, ' ', ''), id, 'label', 0.95, 1, ord from voc union all select lower(replace(code, '-', '')), id, 'code', 0.72, 2, ord from voc union all select syn, id, 'synonym', 0.82, 3, ord from voc),
 names as (select distinct case c_custkey % 5 when 0 then upper(p_name) when 1 then split_part(p_name, ' ', 1) when 2 then 'V' || p_partkey when 3 then 'x ' || substr(split_part(p_name, ' ', 1), 1, 2) || '-' || substr(split_part(p_name, ' ', 2), 1, 2) else c_name end as raw from customer join part on p_partkey = c_custkey),
 best as (select raw, k.id, way, confidence from names join k on k.key = regexp_replace(lower(trim(raw)), '[\\s·\\-_/()]', '', 'g') qualify row_number() over (partition by raw order by rank, ord) = 1)"""


def names(spark, d) -> DataFrame:
    m, words = c("c_custkey") % 5, F.split("p_name", " ")
    code = F.concat(F.lit("x "), F.substring(words[0], 1, 2), F.lit("-"), F.substring(words[1], 1, 2))
    raw = F.when(m == 0, F.upper("p_name")).when(m == 1, words[0]).when(m == 2, F.concat(F.lit("V"), c("p_partkey").cast("string"))).when(m == 3, code).otherwise(c("c_name"))
    return table(spark, d, "customer").join(table(spark, d, "part"), c("p_partkey") == c("c_custkey")).select(raw.alias("raw"), F.lit("item").alias("type"))


@query(_VOC + " select n.raw, b.id, b.way, b.confidence from names n left join best b on b.raw = n.raw")
def i1_normalise(spark, d) -> DataFrame:
    """Names recognised by id, label, code or synonym."""
    return ing.normalised(names(spark, d), vocabulary(spark, d))


@query(
    _VOC + " select n.raw, 'item' as type, coalesce(b.id, 'AUTO_item_' || lpad(printf('%x', cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split(regexp_replace(lower(trim(n.raw)), '[\\s·\\-_/()]', '', 'g'), ''), lambda ch: cast(ord(ch) as bigint))), lambda h, u: (xor(h, u) * 16777619) & 4294967295) as bigint)), 8, '0')) as id, coalesce(b.way, 'new') as way, coalesce(b.confidence, 0.66)::double as confidence from names n left join best b on b.raw = n.raw"
)
def i2_resolve_or_create(spark, d) -> DataFrame:
    return ing.resolve_or_create(names(spark, d), vocabulary(spark, d))


_TURNS = " turns as (select conv_id * 1000 + turn as doc, regexp_replace(lower(text || ' ' || p_name || ' ' || n_name), '\\s+', '', 'g') as t from conversations join part on p_partkey = (conv_id * 7 + turn) % (select count(*) from part) join nation on n_nationkey = conv_id % 25)"


def turns(spark, d) -> DataFrame:
    """Conversation turns that mention a part and a nation."""
    conv = table(spark, d, "conversations").join(F.broadcast(table(spark, d, "part").agg(F.count("*").alias("n"))), F.lit(True))
    rows = conv.withColumn("p_partkey", (c("conv_id") * 7 + c("turn")) % c("n")).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = rows.join(F.broadcast(table(spark, d, "nation")), c("n_nationkey") == c("conv_id") % 25)
    return rows.select((c("conv_id") * 1000 + c("turn")).alias("doc"), F.concat_ws(" ", "text", "p_name", "n_name").alias("text"))


@query(_VOC + "," + _TURNS + " select distinct doc, id from turns join (select id, replace(label, ' ', '') as key from voc union select id, syn from voc) v on length(key) >= 2 and contains(t, key)")
def i3_scan_entities(spark, d) -> DataFrame:
    """Vocabulary names inside free texts; also the containment join of a dictionary."""
    return ing.scan_entities(turns(spark, d), vocabulary(spark, d))


@query(
    _VOC + "," + _TURNS + ", m as (select distinct doc, id, 'item' as type from turns join (select id, replace(label, ' ', '') as key from voc) v on contains(t, key) union select doc, 'IN' || n_nationkey, 'place' from turns join nation on contains(t, lower(n_name))) select distinct a.id as src, 'MADE_IN' as rel, b.id as dst from m a join m b on a.doc = b.doc and a.type = 'item' and b.type = 'place'"
)
def i4_co_mentions(spark, d) -> DataFrame:
    """Parts linked to the nations that the same turn mentions."""
    none = F.array().cast("array<string>")
    items = ing.scan_entities(turns(spark, d), vocabulary(spark, d).withColumn("synonyms", none)).withColumn("type", F.lit("item"))
    places = table(spark, d, "nation").select(F.concat(F.lit("IN"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("label"), none.alias("synonyms"))
    return ing.co_mentions(items.unionByName(ing.scan_entities(turns(spark, d), places).withColumn("type", F.lit("place"))), [("item", "MADE_IN", "place")])


FIELDS = {"item": "part|piece", "fm": "mode|issue", "cause": "cause|reason", "action": "measure|action"}
_PROSE = """with k as (select c_custkey as doc, c_custkey as k, n_name, r_name, c_mktsegment as seg, 'IN' || n_nationkey as item, 'R' || r_regionkey as fm from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
 t as (select *, lower(replace(concat_ws(chr(10), 'seen in ' || n_name, case when k % 3 <> 0 then 'trouble in ' || r_name end, case when k % 2 = 0 then 'cause: ' || seg || ', and more' end, case when k % 5 <> 0 then 'measure： M' || k % 4 || ' / later' end), ' ', '')) as low from k),
 m as (select doc, 'item' as type, 'IN' || n2.n_nationkey as id from t join nation n2 on contains(low, lower(n2.n_name)) union select doc, 'fm', 'R' || r2.r_regionkey from t join region r2 on contains(low, replace(lower(r2.r_name), ' ', ''))
   union select doc, 'cause', 'C_' || s from t, (values ('AUTOMOBILE'), ('BUILDING')) v(s) where contains(low, lower(s)) union select doc, 'cause', 'new' from t where k % 2 = 0 and seg not in ('AUTOMOBILE', 'BUILDING') union select doc, 'action', 'new' from t where k % 5 <> 0),
 free as (select a.doc, a.id as src, r.rel, b.id as dst from m a join (values ('item', 'HAS_FAILURE', 'fm'), ('fm', 'CAUSED_BY', 'cause'), ('fm', 'MITIGATED_BY', 'action')) r(s, rel, t) on r.s = a.type join m b on b.doc = a.doc and b.type = r.t
   union select a.doc, a.id, 'MITIGATED_BY', b.id from m a join m b on b.doc = a.doc and b.type = 'action' where a.type in ('item', 'cause') and a.doc not in (select doc from m where type = 'fm'))"""


def prose(spark, d) -> DataFrame:
    """A text about every customer, with known places and regions, and fields that some lack."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    k = c("c_custkey")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("seen in "), "n_name"), F.when(k % 3 != 0, F.concat(F.lit("trouble in "), "r_name")), F.when(k % 2 == 0, F.concat(F.lit("cause: "), "c_mktsegment", F.lit(", and more"))),
        F.when(k % 5 != 0, F.concat(F.lit("measure： M"), (k % 4).cast("string"), F.lit(" / later"))),
    )
    return rows.select(k.alias("doc"), lines.alias("text"))


def typed_vocabulary(spark, d) -> DataFrame:
    """Nations as parts, regions as failure modes, two segments as causes."""
    none = F.array().cast("array<string>")
    term = lambda rows, kind, key, label, order: rows.select(key.alias("id"), F.lit(kind).alias("type"), label.alias("label"), none.alias("codes"), none.alias("synonyms"), order.cast("long").alias("ord"))
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    causes = spark.createDataFrame([("AUTOMOBILE", 1), ("BUILDING", 2)], "label string, ord int")
    return (
        term(nations, "item", F.concat(F.lit("IN"), "n_nationkey"), c("n_name"), c("n_nationkey"))
        .unionByName(term(regions, "fm", F.concat(F.lit("R"), "r_regionkey"), c("r_name"), 1000 + c("r_regionkey")))
        .unionByName(term(causes, "cause", F.concat(F.lit("C_"), "label"), c("label"), 2000 + c("ord")))
    )


def _told(name: str):
    return F.when(c(name).startswith("AUTO_"), "new").otherwise(c(name)).alias(name)


@query(_PROSE + " select distinct * from free")
def i4_free_text_links(spark, d) -> DataFrame:
    """What free texts suggest: known names, fields with known or new values, and links to measures where no failure mode is named."""
    found = ing.free_text_links(prose(spark, d), typed_vocabulary(spark, d), FIELDS)
    return found.select("doc", _told("src"), "rel", _told("dst")).distinct()


@query(_PROSE + """, stated as (select k as doc, 'P' || k % 7 as src, 'HAS_FAILURE' as rel, 'F' || k % 9 as dst from k where k % 4 = 0 union all select k, 'F' || k % 9, 'MITIGATED_BY', 'dry it' from k where k % 4 = 0)
 select *, 'stated' as way from stated union all select distinct *, 'free text' from free where doc % 4 <> 0""")
def i10_deck_links_or_prose(spark, d) -> DataFrame:
    """Decks: every fourth has the lines of the form, the others are prose."""
    k = c("doc")
    line = lambda s, n, v: F.struct(F.lit(s).alias("slide"), F.lit(n).alias("line"), v.alias("text"))
    form = F.array(line(0, 0, F.concat(F.lit("part: P"), (k % 7).cast("string"))), line(0, 1, F.concat(F.lit("issue: F"), (k % 9).cast("string"))), line(1, 0, F.lit("actions")), line(1, 1, F.lit("dry it")))
    texts = prose(spark, d)
    lines = texts.select("doc", F.explode(F.when(k % 4 == 0, form).otherwise(F.array(line(0, 0, c("text"))))).alias("e")).select("doc", "e.*")
    links = office.deck_links(lines, "part:", "issue:", "causes", "actions")
    found = ing.with_free_text(links, texts, typed_vocabulary(spark, d), FIELDS)
    return found.select("doc", _told("src"), "rel", _told("dst"), "way").distinct()


@query(_PROSE + """, stated as (select k as doc, 'C' || k % 7 as src, 'MITIGATED_BY' as rel, 'A' || k % 9 as dst from k where k % 4 = 1)
 select *, 'stated' as way from stated union all select distinct *, 'free text' from free where doc % 4 <> 1""")
def i11_report_links_or_prose(spark, d) -> DataFrame:
    """Reports: every fourth has keyed paragraphs that give links, the others are prose; paragraphs with keys alone give none."""
    k = c("doc")
    texts = prose(spark, d)
    form = F.array(F.concat(F.lit("why: C"), (k % 7).cast("string")), F.concat(F.lit("done: A"), (k % 9).cast("string")))
    paragraphs = texts.select("doc", F.posexplode(F.when(k % 4 == 1, form).otherwise(F.split("text", "\n"))).alias("pos", "text"))
    links = office.report_links(paragraphs, {"item": "what", "fm": "mode", "cause": "why", "action": "done"})
    found = ing.with_free_text(links, texts, typed_vocabulary(spark, d), FIELDS)
    return found.select("doc", _told("src"), "rel", _told("dst"), "way").distinct()


@query(_PROSE + " select distinct doc, id from m where doc % 4 <> 2 and id <> 'new'")
def i12_drawing_texts_or_labels(spark, d) -> DataFrame:
    """Known objects in the texts of drawings of which no label names an object; every fourth has labels."""
    texts = prose(spark, d)
    return ing.scanned_where_silent(texts, texts.where("doc % 4 = 2").select("doc"), typed_vocabulary(spark, d))


@query(
    """with r as (select 'IP' || l_partkey as item, case when l_linenumber > 1 then 'F' || l_returnflag end as fm, 'C' || l_linenumber as cause, 'IS' || l_suppkey as proj from lineitem)
    select item as src, 'HAS_FAILURE' as rel, fm as dst from r where fm is not null union select fm, 'CAUSED_BY', cause from r where fm is not null union select proj, 'OCCURRED_IN', fm from r where fm is not null"""
)
def i5_worksheet_edges(spark, d) -> DataFrame:
    """Wide worksheet rows as edges; rows without a failure mode give none."""
    name = lambda p, col: F.concat(F.lit(p), c(col).cast("string"))
    rows = table(spark, d, "lineitem").select(name("IP", "l_partkey").alias("item"), F.when(c("l_linenumber") > 1, name("F", "l_returnflag")).alias("fm"), name("C", "l_linenumber").alias("cause"), name("IS", "l_suppkey").alias("proj"))
    return ing.worksheet_edges(rows, [("item", "HAS_FAILURE", "fm"), ("fm", "CAUSED_BY", "cause"), ("proj", "OCCURRED_IN", "fm")])


ROLES = [("item", "part name", 0), ("item", "part", 1), ("fm", "failure mode", 0), ("fm", "failure", 1), ("cause", "cause", 0), ("qty", "qty", 0), ("qty", "quantity", 1)]
_HEADS = "(select s_suppkey as file, unnest([case when s_suppkey % 2 = 0 then 'Parent Part' else 'note' end, 'Part Name', case when s_suppkey % 3 = 0 then 'Failure  Mode' else 'failure' end, 'QTY (ea)']) as name, unnest([0, 1, 2, 3]) as c from supplier)"


def heads(spark, d) -> DataFrame:
    k = c("s_suppkey")
    names_ = F.array(F.when(k % 2 == 0, "Parent Part").otherwise("note"), F.lit("Part Name"), F.when(k % 3 == 0, "Failure  Mode").otherwise("failure"), F.lit("QTY (ea)"))
    return table(spark, d, "supplier").select(k.alias("file"), F.posexplode(names_).alias("c", "name"))


@query(
    f"""with roles as (select role, regexp_replace(syn, '\\s', '', 'g') as s, ord from (values ('item', 'part name', 0), ('item', 'part', 1), ('fm', 'failure mode', 0), ('fm', 'failure', 1), ('cause', 'cause', 0), ('qty', 'qty', 0), ('qty', 'quantity', 1)) t(role, syn, ord)),
    h as (select file, c, name, regexp_replace(lower(trim(name)), '[\\s·\\-_/()]', '', 'g') as h from {_HEADS})
    select file, role, name from h join roles on contains(h, s) qualify row_number() over (partition by file, role order by case when h = s then 0 else 1 end, ord, c) = 1"""
)
def i7_matched_columns(spark, d) -> DataFrame:
    """Columns of a bill of materials under differing headers."""
    return ing.matched_columns(heads(spark, d), spark.createDataFrame(ROLES, "role string, synonym string, ord int"))


@query("select s_suppkey as file, 's' as sheet, s_suppkey % 4 as row, case when s_suppkey % 2 = 0 then 1 else 2 end as span, case when s_suppkey % 2 = 0 then ['fm', 'item', 'qty'] else ['cause', 'fm', 'item', 'qty'] end as roles from supplier")
def i8_detected_header(spark, d) -> DataFrame:
    """Header of one or two rows below title rows; where it has two, the second names the cause."""
    k = c("s_suppkey")
    top = (k % 4).cast("int")
    cell = lambda r, col, v: F.struct(r.cast("int").alias("r"), F.lit(col).alias("c"), v.alias("value"))
    cause = F.when(k % 2 == 1, "root cause").otherwise("steel")
    cells = F.array(cell(top, 0, F.lit("Part Name")), cell(top, 1, F.lit("Failure Mode")), cell(top, 2, F.lit("Quantity")), cell(top + 1, 3, cause), cell(top + 2, 0, F.lit("bolt")))
    rows = table(spark, d, "supplier").select(k.alias("file"), F.lit("s").alias("sheet"), F.explode(cells).alias("e")).select("file", "sheet", "e.*")
    return ing.detected_header(rows, spark.createDataFrame(ROLES, "role string, synonym string, ord int"))


def records(spark, d) -> DataFrame:
    """Extractions out of conversations: roles and turns as entities, each turn related to the role that spoke."""
    t = table(spark, d, "conversations")
    name = F.concat(F.lit("Turn "), c("turn").cast("string"))
    e = F.array(F.struct(F.lit("role").alias("type"), c("role").alias("label")), F.struct(F.lit("turn").alias("type"), name.alias("label")))
    r = F.struct(F.lower(name).alias("srcLabel"), F.lit("SAID_BY").alias("rel"), F.when(c("turn") % 5 == 4, "nobody").otherwise(F.upper("role")).alias("dstLabel"))
    grouped = t.groupBy(c("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", e.alias("e"), r.alias("r")))).alias("x"))
    return grouped.select("doc", F.flatten(F.transform("x", lambda v: v["e"])).alias("entities"), F.transform("x", lambda v: v["r"]).alias("relations"))


_SLUG = "lower(replace({0}, ' ', '-')) || '-' || substr(sha1({1} || '|' || {0}), 1, 8)"


@query("select distinct " + _SLUG.format("('Turn ' || turn)", "'turn'") + " as src, 'SAID_BY' as rel, " + _SLUG.format("role", "'role'") + " as dst from conversations where turn % 5 <> 4")
def i15_extraction_edges(spark, d) -> DataFrame:
    """Relations bound to the entities of their document by folded label."""
    return ing.extraction_to_graph(records(spark, d))[1]


@query("select distinct " + _SLUG.format("('Turn ' || turn)", "'turn'") + " as id, 'turn' as type, 'Turn ' || turn as label from conversations union select distinct " + _SLUG.format("role", "'role'") + ", 'role', role from conversations")
def i15_extraction_nodes(spark, d) -> DataFrame:
    return ing.extraction_to_graph(records(spark, d))[0].select("id", "type", "label")


@query("select conv_id as doc, 'chat' as doc_type, cast(2 * count(*) as int) as entities, cast(count(*) as int) as relations, list_sort(list(distinct role)) as roles from conversations group by conv_id")
def i16_standard_records(spark, d) -> DataFrame:
    """Flat document rows; the roles are read back from the lossless record."""
    rows = records(spark, d).select("doc", F.lit("f").alias("file"), F.lit("chat").alias("doc_type"), F.lit("s").alias("summary"), "entities", "relations")
    back = F.from_json("record", "entities array<struct<type:string,label:string>>")["entities"]
    roles = F.array_sort(F.array_distinct(F.transform(F.filter(back, lambda e: e["type"] == "role"), lambda e: e["label"])))
    return ing.standard_records(rows).select("doc", "doc_type", "entities", "relations", roles.alias("roles"))


@query("select doc_id, case when text is null or trim(text) = '' then 'no text' when length(text) < 60 then 'no entity' else 'done' end as status, least(length(text), 12000) as used from documents")
def i17_file_status(spark, d) -> DataFrame:
    """Why a file was passed over, and how much of its text an extraction would get."""
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").when(F.length("text") < 60, "no entity").otherwise("done")
    return table(spark, d, "documents").select("doc_id", status.alias("status"), F.least(F.length("text"), F.lit(12000)).alias("used"))


@query("select 'DOC_' || lower(lang) || doc as id, 'doc' as type, lang || ' ' || doc as label, 'D' || min(doc_id) as parent from (select *, doc_id % 50 as doc from documents) group by lang, doc")
def i13_document_nodes(spark, d) -> DataFrame:
    """Files with the first object they brought."""
    rows = table(spark, d, "documents").select(F.concat_ws(" ", "lang", (c("doc_id") % 50).cast("string")).alias("file"), F.concat(F.lit("D"), c("doc_id").cast("string")).alias("id"), c("doc_id").alias("ord"))
    return ing.document_nodes(rows)[0]


def drawings(spark, d) -> DataFrame:
    """A drawing per order: a title, then all its parts as texts in a grid."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    text = lambda x, y, v: F.concat_ws("\n", F.lit("0"), F.lit("TEXT"), F.lit("8"), F.lit("notes"), F.lit("10"), x, F.lit("20"), y, F.lit("1"), v)
    cell = lambda v, i: text((i % 3 * 40).cast("string"), (100 - F.floor(i / 3) * 10).cast("string"), F.concat(F.lit("P"), v.cast("string")))
    return rows.select(c("l_orderkey").alias("file"), F.concat(F.lit("999\ncomment\n"), F.array_join(F.transform("p", cell), "\n"), F.lit("\n0\nEOF")).alias("text"))


_DRAWN = "with p as (select l_orderkey as file, unnest(list_sort(list(distinct l_partkey))) as part, generate_subscripts(list_sort(list(distinct l_partkey)), 1) - 1 as i from lineitem group by l_orderkey)"


@query(_DRAWN + " select file, 'notes' as layer, cast(i % 3 * 40 as double) as x, cast(100 - i // 3 * 10 as double) as y, 'P' || part as value from p")
def s10_drawing_entities(spark, d) -> DataFrame:
    """Code and value lines of drawings as entities."""
    return src.drawing_entities(drawings(spark, d)).where("kind = 'TEXT'").select("file", "layer", "x", "y", "value")


@query(_DRAWN + " select file, cast(1 + i // 3 as bigint) as row, 'c' || (i % 3) as name, 'P' || part as value from p")
def i12_drawing_grid(spark, d) -> DataFrame:
    """Texts of drawings put back into rows and columns."""
    texts = src.drawing_entities(drawings(spark, d)).where("kind = 'TEXT'").select("file", "x", "y", "value")
    three = F.explode(F.array(*(F.struct(F.lit(float(40 * i + 3)).alias("x"), F.lit(f"c{i}").alias("name")) for i in range(3))))
    heads_ = texts.select("file").distinct().select("file", three.alias("h")).select("file", "h.x", "h.name")
    return ing.nearest_column(ing.grid_rows(texts), heads_)


@query(_DRAWN + ", t as (select file, i % 3 * 40.0 as x, 100 - i // 3 * 10.0 as y, part from p) select a.file, 'P' || a.part as one, 'P' || b.part as other, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::double, 6) as distance from t a join t b on a.file = b.file and a.part % 2 = 0 and b.part % 2 = 1 where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 41")
def j12_near_texts(spark, d) -> DataFrame:
    """Texts of two kinds close to each other on a drawing; also the vent and heat source rule."""
    texts = src.drawing_entities(drawings(spark, d)).where("kind = 'TEXT'").select("file", "x", "y", "value")
    even = F.substring("value", 2, 20).cast("long") % 2 == 0
    return ing.near_pairs(texts, even, ~even, 41).withColumn("distance", F.round("distance", 6))


@query("select conv_id * 1000 + turn as file, role as sender, 'conversation ' || conv_id as subject, trim(regexp_replace(replace(text, chr(13), ''), '[ \\t\\n]+', ' ', 'g')) as body from conversations")
def s8_mails(spark, d) -> DataFrame:
    """Turns written as mails and parsed back, every second one as quoted HTML."""
    key = (c("conv_id") * 1000 + c("turn")).cast("string")
    kind = F.when(c("turn") % 2 == 0, "text/plain").otherwise("text/html")
    body = F.when(c("turn") % 2 == 0, c("text")).otherwise(F.concat(F.lit("<html><p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p></html>")))
    mail = F.concat(F.lit("From: "), "role", F.lit("\r\nSubject: conversation "), c("conv_id").cast("string"), F.lit("\r\nContent-Type: "), kind, F.lit("; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(body.cast("binary")), F.lit("\r\n"))
    files = table(spark, d, "conversations").select(key.alias("file"), mail.cast("binary").alias("content"))
    tight = F.trim(F.regexp_replace(F.replace("body", F.lit("\r"), F.lit("")), "[ \t\n]+", " "))
    return src.read_mails(files).select(c("file").cast("long").alias("file"), "sender", "subject", tight.alias("body"))


@query("select doc_id as file, case when doc_id % 2 = 0 then 'new' || doc_id else lang end as content from documents where doc_id % 3 <> 0")
def s12_source_contents(spark, d) -> DataFrame:
    """Contents of registered files, uploads before the baseline."""
    docs = table(spark, d, "documents").select(c("doc_id").alias("file"), c("lang").alias("content"))
    return src.contents(docs.where("file % 3 <> 0"), docs.where("file % 2 = 0").withColumn("content", F.concat(F.lit("new"), c("file").cast("string"))), docs)


@query(
    """with docs as (select count(*) as n from documents), l as (select l_orderkey % n as file, 'IP' || l_partkey as src, 'IS' || l_suppkey as dst from lineitem, docs where l_orderkey % 3 <> 0),
    o as (select file, count(distinct x) as objects from (select file, src as x from l union all select file, dst from l) group by file), r as (select file, count(*) as relations from l group by file)
    select doc_id as file, lang as kind, length(coalesce(text, '')) as size, coalesce(substr(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 120), '') as preview, coalesce(objects, 0) as objects, coalesce(relations, 0) as relations
    from documents left join o on o.file = doc_id left join r on r.file = doc_id"""
)
def s13_source_summary(spark, d) -> DataFrame:
    """Every source with the summary of what was drawn from it; line items stand for links that the documents assert."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))
    links = table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").join(F.broadcast(n), F.lit(True))
    links = links.select((c("l_orderkey") % c("n")).alias("file"), F.concat(F.lit("IP"), "l_partkey").alias("src"), F.lit("MADE_BY").alias("rel"), F.concat(F.lit("IS"), "l_suppkey").alias("dst"))
    return office.source_list(docs.select(c("doc_id").alias("file"), c("lang").alias("kind"), "text"), links)


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")


@query("select 'main' as canvas_id, 'U' || user_id as id, min_by(event_type, event_id) as label, min(event_id) as ord from events group by user_id")
def r1_stream_merge(spark, d) -> DataFrame:
    """Nodes out of the event stream, the first of each user, merged batch by batch."""
    out = new_folder(spark, "nodes")
    nodes = changes.NodeTable(spark, out, "canvas_id string, id string, label string, ord long")
    rows = event_stream(spark, d).select(F.lit("main").alias("canvas_id"), F.concat(F.lit("U"), c("user_id").cast("string")).alias("id"), c("event_type").alias("label"), c("event_id").alias("ord"))
    rows.writeStream.foreachBatch(nodes.merge()).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    return nodes.read().drop("batch_id")


@query("select date_trunc('hour', ts) as start, event_type as op, count(*) as entries from events group by all")
def r3_log_windows(spark, d) -> DataFrame:
    """Operations of the change log by the hour, as a stream: all entries, those of windows that are not over too."""
    out = new_folder(spark, "log")
    counts = changes.LogCounts(spark, out, "timestamp_ntz")
    rows = event_stream(spark, d).select(c("ts").cast("timestamp_ntz").alias("at"), c("event_type").alias("op"))
    rows.writeStream.foreachBatch(counts.add()).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    return counts.read()


@query("select distinct user_id, event_type from events")
def r5_first_wins(spark, d) -> DataFrame:
    """Which users did what, each pair once, as a stream that forgets a pair a year after its first row."""
    out = new_folder(spark, "first")
    rows = event_stream(spark, d).select("user_id", "event_type", c("ts").cast("timestamp").alias("at"))
    found = changes.first_wins(rows, ["user_id", "event_type"], "at", "365 days").select("user_id", "event_type")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
