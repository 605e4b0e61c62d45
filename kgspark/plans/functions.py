"""Queries on scalar functions, over the columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import domain, text
from kgspark.sources.tables import table
from kgspark.sources.tables import edges as all_edges
from kgspark.sources.tables import nodes as all_nodes

from .graph import g
from .registry import query

c = F.col
_FOLD = "regexp_replace(lower(trim({})), '[\\s·\\-_/()]', '', 'g')"
_FNV = "lpad(printf('%x', cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split({}, ''), lambda ch: cast(ord(ch) as bigint))), lambda h, u: (xor(h, u) * 16777619) & 4294967295) as bigint)), 8, '0')"


@query("select doc_id, nfc_normalize(text) as text from documents")
def f1_nfc(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfc(c("text")).alias("text"))


@query("select p_partkey, " + _FOLD.format("p_name || ' ' || p_type || ' (' || p_brand || ')'") + " as folded from part")
def f2_fold(spark, d) -> DataFrame:
    label = F.concat("p_name", F.lit(" "), "p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.fold(label).alias("folded"))


@query("select p_partkey, " + _FNV.format("p_name || '한글' || p_partkey") + " as hash from part")
def f3_fnv1a(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fnv1a(F.concat("p_name", F.lit("한글"), c("p_partkey").cast("string"))).alias("hash"))


@query("with f as (select p_partkey, " + _FOLD.format("p_name || '-' || p_partkey") + " as x from part) select p_partkey, 'AUTO_item_' || " + _FNV.format("x") + " as id from f")
def f4_auto_id(spark, d) -> DataFrame:
    label = F.concat("p_name", F.lit("-"), c("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.auto_id(F.lit("item"), label).alias("id"))


@query(
    """with s as (select c_custkey, l, regexp_replace(regexp_replace(lower(l), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, substr(sha1('proj|' || l), 1, 8) as h
    from (select c_custkey, case when c_custkey % 5 = 0 then '한글' else c_name end as l from customer)) select c_custkey, case when slug = '' then h else slug || '-' || h end as id from s"""
)
def f5_entity_id(spark, d) -> DataFrame:
    label = F.when(c("c_custkey") % 5 == 0, "한글").otherwise(c("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.entity_id(F.lit("proj"), label).alias("id"))


@query("select doc_id, regexp_replace(lower(text), '\\s+', '', 'g') as tight, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as squeezed from documents")
def f7_spaces(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nospace(c("text")).alias("tight"), text.squeezed(c("text")).alias("squeezed"))


@query("select p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' a ' || p_name || '/' || p_brand), '[\\s·\\-_/()]+'), lambda t: length(t) >= 2))) as tokens from part")
def f8_tokens(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_sort(text.tokens(F.concat("p_name", F.lit(" a "), "p_name", F.lit("/"), "p_brand"))).alias("tokens"))


@query("select event_id, least(greatest(value / 10 - 1, 0.0), 1.0) as share, cast(floor(value + 0.5) as int) as rounded from events")
def f9_clamp_and_round(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.clamp01(c("value") / 10 - 1).alias("share"), text.half_up(c("value")).alias("rounded"))


@query(
    """with t as (select event_id, 0.4::double * least(greatest(value / 50, 0.0), 1.0) as sim, 0.15::double * least(user_id % 15 / 10.0::double, 1.0) as evid, 0.3::double * least((event_id % 11) / 10.0::double, 1.0) as sev,
      case when user_id % 2 = 0 then 0.15::double else 0.0 end as master, (event_id % 4) * 0.1::double as boost from events),
    r as (select *, sim + evid + sev + master + boost as raw from t)
    select event_id, cast(floor(least(greatest(raw, 0.0), 1.0) * 100 + 0.5) as int) as confidence, round(sim / greatest(raw, 1), 6) as sim, round(boost / greatest(raw, 1), 6) as boost from r"""
)
def f10_confidence(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    found = domain.confidence(c("value") / 50, c("user_id") % 15, c("event_id") % 11, c("user_id") % 2 == 0, (c("event_id") % 4) * 0.1)
    return e.select("event_id", found.alias("f")).select("event_id", "f.confidence", F.round("f.sim", 6).alias("sim"), F.round("f.boost", 6).alias("boost"))


@query("select l_orderkey, l_linenumber, s * o * dd as rpn, case when s * o * dd >= 125 then 'high' when s * o * dd >= 60 then 'middle' else 'low' end as priority from (select l_orderkey, l_linenumber, l_linenumber % 10 + 1 as s, l_partkey % 10 + 1 as o, l_suppkey % 10 + 1 as dd from lineitem)")
def f11_risk_number(spark, d) -> DataFrame:
    rpn = (c("l_linenumber") % 10 + 1) * (c("l_partkey") % 10 + 1) * (c("l_suppkey") % 10 + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rpn.alias("rpn")).withColumn("priority", domain.priority(c("rpn")))


_VENT = "case when p_size % 3 = 0 then p_size || ' (' || p_brand || ' )' when p_size % 3 = 1 then p_size || ' holes' else p_name end"


@query(f"select p_partkey, try_cast(nullif(regexp_extract(v, '([0-9]+)\\s*(?:\\(([^)]+)\\))?', 1), '') as int) as n, nullif(trim(regexp_extract(v, '([0-9]+)\\s*(?:\\(([^)]+)\\))?', 2)), '') as layout from (select p_partkey, {_VENT} as v from part)")
def f12_vent_note(spark, d) -> DataFrame:
    note = F.expr(_VENT.replace("p_size ||", "cast(p_size as string) ||"))
    return table(spark, d, "part").select("p_partkey", domain.vent(note).alias("v")).select("p_partkey", F.col("v.count").alias("n"), "v.layout")


_A, _B = "case when p_partkey % 7 = 0 then null else p_name end", "case when p_partkey % 3 = 0 then replace(upper(p_name), ' ', '') when p_partkey % 3 = 1 then split_part(p_name, ' ', 1) else p_brand end"


@query(
    f"""with x as (select p_partkey, regexp_replace(lower({_A}), '\\s+', '', 'g') as a, regexp_replace(lower({_B}), '\\s+', '', 'g') as b from part)
    select p_partkey, case when a = b then 1.0::double when contains(a, b) or contains(b, a) then 0.5::double when a is not null and b is not null then 0.0::double end as similarity from x"""
)
def f13_string_similarity(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", domain.string_similarity(F.expr(_A), F.expr(_B)).alias("similarity"))


@query("select p_partkey, case when p_size % 12 = p_partkey % 10 then 1.0::double when abs(p_size % 12 - p_partkey % 10) <= 1 then 0.5::double else 0.0::double end as similarity from part")
def f14_grade_similarity(spark, d) -> DataFrame:
    grade = lambda x: F.concat(F.lit("IP"), x.cast("string"))
    return table(spark, d, "part").select("p_partkey", domain.grade_similarity(grade(c("p_size") % 12), grade(c("p_partkey") % 10)).alias("similarity"))


_MATERIAL = "case p_size % 6 when 0 then 'pc' when 1 then 'PC+ABS gf30' when 2 then 'epdm foam' when 3 then '고무 패드' when 4 then 'steel' else 'FR-4' end"


@query(f"select p_partkey, case p_size % 6 when 0 then 65 when 1 then 75 when 2 then 160 when 3 then 150 when 4 then null else 16 end as expansion from part")
def f15_expansion(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", domain.expansion(F.expr(_MATERIAL)).alias("expansion"))


@query("select c_custkey, regexp_matches(v, '^\\s*[+-]?[.]?[0-9]') as starts, regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') as is_decimal from (select c_custkey, case c_custkey % 5 when 0 then cast(c_custkey as varchar) when 1 then '-' || c_custkey || '.5' when 2 then c_custkey || ' EA' when 3 then 'EA ' || c_custkey else ' .5' end as v from customer)")
def f16_lenient_numbers(spark, d) -> DataFrame:
    """Also decides which literals of an export are decimals."""
    k = c("c_custkey").cast("string")
    m = c("c_custkey") % 5
    v = F.when(m == 0, k).when(m == 1, F.concat(F.lit("-"), k, F.lit(".5"))).when(m == 2, F.concat(k, F.lit(" EA"))).when(m == 3, F.concat(F.lit("EA "), k)).otherwise(" .5")
    return table(spark, d, "customer").select("c_custkey", text.starts_as_number(v).alias("starts"), text.is_decimal(v).alias("is_decimal"))


SYNONYMS = [("small", "little"), ("ring", "loop"), ("blue", "azure"), ("widget", "gadget")]
_SYN_SQL = " union all ".join(f"select '{a}' as one, '{b}' as other union all select '{b}', '{a}'" for a, b in SYNONYMS)


@query(f"with syn as ({_SYN_SQL}), q as (select distinct p_name as q from part) select q, q as term from q union select q, one from q join syn on contains(q, one) union select q, other from q join syn on contains(q, one)")
def f17_synonyms(spark, d) -> DataFrame:
    """Queries with the terms they stand for."""
    pairs = spark.createDataFrame([p for a, b in SYNONYMS for p in ((a, b), (b, a))], "one string, other string")
    asked = table(spark, d, "part").select(c("p_name").alias("q")).distinct()
    met = asked.join(F.broadcast(pairs), c("q").contains(c("one"))).select("q", F.explode(F.array("one", "other")).alias("term"))
    return asked.select("q", c("q").alias("term")).unionByName(met).distinct()


@query("select s_suppkey, case when s_suppkey % 4 = 0 then null else s_name end as part, cast(s_nationkey as varchar) as cause from supplier")
def f19_key_values(spark, d) -> DataFrame:
    """Fields written as "key: value" lines."""
    label = F.when(c("s_suppkey") % 4 == 0, F.lit("no field")).otherwise(F.concat(F.lit(" Part : "), "s_name", F.lit(" / other, more")))
    note = F.concat_ws("\n", F.lit("Report"), label, F.concat(F.lit("reason: "), c("s_nationkey").cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", text.field(note, "Part|Item").alias("part"), text.field(note, "cause|reason").alias("cause"))


@query("select event_id, case when event_id % 3 = 2 then null else cast(json_extract(props, '$.k') as bigint) end as k from events")
def f20_json_salvage(spark, d) -> DataFrame:
    """JSON inside an answer with thoughts and chatter around it."""
    m = c("event_id") % 3
    answer = F.when(m == 0, F.concat(F.lit("<think>{no}\n</think> sure: "), "props", F.lit(" done"))).when(m == 1, c("props")).otherwise("no json")
    return table(spark, d, "events").select("event_id", F.get_json_object(text.outer_json(answer), "$.k").cast("long").alias("k"))


@query("select conv_id, count(*) filter (where turn % 3 <> 0) as entities, count(*) filter (where turn % 2 = 0) as relations from conversations group by conv_id")
def f21_extraction_normalised(spark, d) -> DataFrame:
    """Extraction JSON with blank and malformed entries left out."""
    turns = table(spark, d, "conversations")
    e = F.struct(F.lit("item").alias("type"), F.when(c("turn") % 3 == 0, "  ").otherwise(c("role")).alias("label"))
    r = F.struct(c("role").alias("srcLabel"), F.when(c("turn") % 2 == 0, F.lit("HAS")).alias("rel"), F.lit("x").alias("dstLabel"))
    raw = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(e).alias("entities"), F.collect_list(r).alias("relations"))).alias("j"))
    parsed = raw.select("conv_id", F.from_json("j", "entities array<struct<type:string,label:string>>, relations array<struct<srcLabel:string,rel:string,dstLabel:string>>").alias("x"))
    good = F.filter("x.entities", lambda v: F.length(F.trim(v["label"])) > 0)
    full = F.filter("x.relations", lambda v: v["srcLabel"].isNotNull() & v["rel"].isNotNull() & v["dstLabel"].isNotNull())
    return parsed.select("conv_id", F.size(good).cast("long").alias("entities"), F.size(full).cast("long").alias("relations"))


@query("select a.vec_id, round(list_cosine_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f22_cosine_distance(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(text.cosine_distance(c("embedding"), c("other")), 6).alias("distance"))


@query(g(" select id, 'passage: ' || concat_ws(' ', label, nullif(array_to_string(list_transform(props, lambda p: p.v), ' '), '')) as passage, 'query: ' || label as question from nodes where type in ('item', 'proj', 'fm')"))
def f23_embedding_texts(spark, d) -> DataFrame:
    """Inputs of an embedder for nodes (label and property values) and for questions."""
    values = F.nullif(F.array_join(F.transform("props", lambda p: p["v"]), " "), F.lit(""))
    rows = all_nodes(spark, d).where("type in ('item', 'proj', 'fm')")
    return rows.select("id", F.concat(F.lit("passage: "), F.concat_ws(" ", "label", values)).alias("passage"), F.concat(F.lit("query: "), "label").alias("question"))


@query("with j as (select c_custkey, '{\"market\":\"' || n_name || '\",\"segment\":\"' || c_mktsegment || '\"}' as k from customer join nation on c_nationkey = n_nationkey) select c_custkey, k as key, " + _FNV.format("k") + " as hash from j")
def f25_condition_key(spark, d) -> DataFrame:
    """Canonical JSON of a condition and its hash."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return rows.select("c_custkey", F.to_json(F.struct(c("n_name").alias("market"), c("c_mktsegment").alias("segment"))).alias("key")).withColumn("hash", text.fnv1a(c("key")))


@query("select doc_id, case when length(text) > 120 then substr(text, 1, 120) || '…' else text end as short from documents")
def f26_ellipsis(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.ellipsis(c("text")).alias("short"))


@query(g(" select src, rel, dst, coalesce(weight, try_cast(nullif(regexp_extract(r, '([0-9]*[.]?[0-9]+)', 1), '') as double)) as weight, src || '→' || rel || '→' || dst as hop from (select *, case when rel = 'CAUSED_BY' then 'SIMILAR 0.8' || substr(src, 4, 1) else rel end as r from edges where rel in ('SIMILAR', 'CAUSED_BY', 'UNDER_REG'))"))
def f28_edge_weight(spark, d) -> DataFrame:
    rel = F.when(c("rel") == "CAUSED_BY", F.concat(F.lit("SIMILAR 0.8"), F.substring("src", 4, 1))).otherwise(c("rel"))
    rows = all_edges(spark, d).where("rel in ('SIMILAR', 'CAUSED_BY', 'UNDER_REG')")
    return rows.select("src", "rel", "dst", text.edge_weight(c("weight"), rel).alias("weight"), text.hop(c("src"), c("rel"), c("dst")).alias("hop"))


@query("select c_custkey, c_custkey % 4 in (0, 1) as hit from customer")
def f29_market_words(spark, d) -> DataFrame:
    """Whether a text names a market by one of its words."""
    m = c("c_custkey") % 4
    market = F.when(m == 0, "북미 시장").when(m == 1, "Mars").when(m == 2, "유럽").otherwise("")
    note = F.when(m == 0, "meets FMVSS 108").when(m == 1, "sold on Mars").otherwise("Asia only")
    return table(spark, d, "customer").select("c_custkey", domain.holds_any(note, domain.market_words(market)).alias("hit"))


@query(
    """select o_orderkey, least(10, 9 - o_orderkey % 3 + case when c_mktsegment || ' FORM' like '%BUILDING%' and regexp_matches('F' || o_orderstatus || ' ' || o_orderpriority, 'URGENT|HIGH') then 1 else 0 end
      + case when c_custkey % 2 = 0 and regexp_matches('F' || o_orderstatus || ' ' || o_orderpriority, 'FO|LOW') then 1 else 0 end) as occurrence from orders join customer on o_custkey = c_custkey"""
)
def f31_boosted_occurrence(spark, d) -> DataFrame:
    """Occurrence of an order's trouble, raised by the customer's shape and light where failure or cause meet them, at most 10."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    rules = [("shape", "BUILDING", "URGENT|HIGH"), ("light", "(?i)LED", "FO|LOW")]
    light = F.when(c("c_custkey") % 2 == 0, "led bar")
    boost = domain.occurrence_boost(F.array("c_mktsegment", F.lit("FORM")), light, F.concat(F.lit("F"), "o_orderstatus"), c("o_orderpriority"), rules)
    return rows.select("o_orderkey", F.least(F.lit(10), 9 - c("o_orderkey") % 3 + boost).alias("occurrence"))


@query("select conv_id, turn, 'From: ' || role || chr(10) || 'Subject: conversation ' || conv_id || chr(10) || chr(10) || text as block from conversations")
def f32_mail_block(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.format_string("From: %s\nSubject: conversation %d\n\n%s", "role", "conv_id", "text").alias("block"))


@query("select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) as text from pages")
def s9_strip_html(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.stripped_html(c("html")).alias("text"))
