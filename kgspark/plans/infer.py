"""Queries on inference, drafts, shapes and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kgspark.operators import infer as inf
from kgspark.operators import parts, shapes
from kgspark.operators.lineage import settle
from kgspark.sources.tables import graph, table
from kgspark.sources.tables import edges as all_edges

from .graph import g
from .registry import query

c = F.col


def conditions(spark, d) -> DataFrame:
    """Every twentieth customer as the seed of a design for its region and segment; a quarter of them has no seed."""
    cust = table(spark, d, "customer").where("c_custkey % 20 = 0").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    seed = F.when(c("c_custkey") % 80 != 0, F.concat(F.lit("PJ"), c("c_custkey").cast("string")))
    return cust.select(c("c_custkey").alias("cid"), seed.alias("seed"), c("r_name").alias("market"), F.lit("LED").alias("light"), F.array(F.concat(c("c_mktsegment"), F.lit(" F 3"))).alias("shape"))


_SCORED = """, cond as (select c_custkey as cid, case when c_custkey % 80 <> 0 then 'PJ' || c_custkey end as seed, r_name as market, c_mktsegment as seg from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 20 = 0),
 txt as (select id, ord, label || ' ' || coalesce(sub, '') || ' ' || array_to_string(list_transform(props, lambda p: p.k || ' ' || p.v), ' ') as t from nodes where type = 'proj'),
 m as (select cid, seed, id, ord, ((case when contains(t, market) then 1 else 0 end + case when contains(t, seg) then 1 else 0 end + case when contains(t, 'LED') then 1 else 0 end) / 3.0::double) as match from cond, txt),
 linked as (select m.cid, m.id, least(0.65::double * e.weight + 0.35::double * match, 1.0) as sim, e.ord as o from m join edges e on e.rel = 'SIMILAR' and e.src = m.seed and e.dst = m.id),
 both_ as (select * from linked union all select cid, id, match, ord from m where cid not in (select cid from linked) and match > 0 and id is distinct from seed),
 proj as (select cid, id, sim, row_number() over (partition by cid order by sim desc, o) as place from both_ qualify place <= 5)"""


@query(g(_SCORED + " select cid, id, round(sim, 6) as sim, place from proj"))
def g11_scored_projects(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return inf.scored_projects(conditions(spark, d), gr.nodes, gr.edges).withColumn("sim", F.round("sim", 6))


def severity():
    return F.get(F.filter("props", lambda p: p["k"] == "severity"), F.lit(0))["v"].cast("int")


_CONCERN = _SCORED + """, v as (select p.cid, e.dst as fm, p.id as anchor, p.sim from proj p join edges e on e.rel = 'OCCURRED_IN' and e.src = p.id),
 r as (select v.cid, v.fm, max(sim) as sim, count(*) as visits, list_sort(list(distinct anchor)) as anchors, 10 - cast(substr(v.fm, 4, 1) as int) as severity, c.market,
   bool_or(exists (select 1 from edges u join nodes n on n.id = u.dst where u.rel = 'UNDER_REG' and u.src = v.fm and contains(n.label, c.market))) as regulated from v join cond c using (cid) group by v.cid, v.fm, c.market),
 s as (select *, 0.4::double * sim as t1, 0.3::double * (severity / 10.0::double) as t2, case when regulated then 0.08::double else 0.0 end * visits as t3 from r),
 found as (select *, cast(floor(least(t1 + 0.0 + t2 + 0.0 + t3, 1.0) * 100 + 0.5) as int) as confidence from s)"""


@query(g(_CONCERN + " select cid, fm, severity, visits, regulated, confidence, round(t3 / greatest(t1 + t2 + t3, 1), 6) as boost, list_transform(anchors, lambda a: a || '→OCCURRED_IN→' || fm) as trace from found"))
def g13_concerns(spark, d) -> DataFrame:
    """Failure modes of the projects like each condition, with confidence and trace."""
    gr = graph(spark, d)
    cond = conditions(spark, d)
    seen = inf.visits(inf.scored_projects(cond, gr.nodes, gr.edges), gr.edges)
    found = inf.concerns(seen, cond.withColumn("shape", F.array().cast("array<string>")), gr.nodes, gr.edges, severity())
    return found.select("cid", "fm", "severity", "visits", "regulated", "confidence", F.round("boost", 6).alias("boost"), "trace")


RULES = [("urgent", "^[12]-", 0.1), ("light", "LOW|NOT", 0.08), ("closed", "MEDIUM", 0.1)]
_CHECK = _SCORED.replace("c_mktsegment as seg from", "c_mktsegment as seg, 'FRF' || (c_custkey // 20 % 5 + 1) as tok from").replace("then 1 else 0 end) / 3.0::double", "then 1 else 0 end) / 4.0::double") + """,
 v as (select p.cid, e.dst as fm, p.id as anchor, p.sim, p.place, e.ord from proj p join edges e on e.rel = 'OCCURRED_IN' and e.src = p.id),
 r as (select v.cid, v.fm, max(sim) as sim, count(*) as visits, list_sort(list(distinct anchor)) as anchors, list(n.label order by v.place, v.ord) as origins, min((v.place, v.ord)) as turn, 10 - cast(substr(v.fm, 4, 1) as int) as severity,
   bool_or(exists (select 1 from edges u join nodes n on n.id = u.dst where u.rel = 'UNDER_REG' and u.src = v.fm and contains(n.label, c.market))) as regulated, any_value(c.seg) as seg, any_value(c.tok) as tok
   from v join cond c using (cid) join nodes n on n.id = v.anchor group by v.cid, v.fm),
 s as (select *, least(0.4::double * sim + 0.3::double * (severity / 10.0::double) + visits * (case when regulated then 0.08::double else 0.0 end + case when contains(fm, tok) then 0.06::double else 0.0 end)
   + case when contains(seg, 'AUTO') and fm like '%3' then 0.1::double else 0.0 end, 1.0) as raw from r),
 mit as (select e.src as fm, n.label from edges e join nodes n on n.id = e.dst where e.rel = 'MITIGATED_BY'),
 fms as (select cid, fm as anchor, case when regulated then 'regulatory' else 'failure-mode' end as category, severity, list_transform(anchors, lambda a: a || '→OCCURRED_IN→' || fm) as trace,
   list_concat(case when mit.label is null then [] else [mit.label] end, origins) as evidence, cast(floor(raw * 100 + 0.5) as int) as confidence, sim, turn, 0 as late, seg from s left join mit using (fm)),
 rules as (select * from (values ('urgent', 0, 'C1', 0.1::double), ('light', 1, 'C4', 0.08::double), ('closed', 2, 'C3', 0.1::double)) t(rule, rank, cause, w)),
 hit as (select f.cid, rule, r.cause, w, arg_min({'fm': anchor, 'trace': trace, 'sim': sim, 'turn': turn}, turn) as s from fms f join rules r on substr(r.cause, 2) = substr(f.anchor, 4) and exists (select 1 from edges where rel = 'CAUSED_BY' and src = f.anchor)
   where case rule when 'urgent' then regexp_matches(seg, 'BUILD|MACH') when 'light' then true else contains(seg, 'AUTO') end group by all),
 back as (select dst as cause, arg_min(src, ord) as related from edges where rel = 'CAUSED_BY' group by dst),
 causes as (select cid, cause as anchor, rule as category, 10 - cast(substr(related, 4, 1) as int) as severity,
   list_concat(s.trace, case when s.fm = related then [related || '→CAUSED_BY→' || cause] else [s.fm || '→CAUSED_BY→' || cause, related || '→CAUSED_BY→' || cause] end) as trace, [related] as evidence,
   cast(floor(least(0.4::double * s.sim + 0.3::double * ((10 - cast(substr(related, 4, 1) as int)) / 10.0::double) + w, 1.0) * 100 + 0.5) as int) as confidence, s.turn as turn, 1 as late from hit join back using (cause)),
 every as (select cid, anchor, category, severity, trace, evidence, confidence, turn, late from fms union all select cid, anchor, category, severity, trace, evidence, confidence, turn, late from causes)"""


def checked(spark, d):
    """Conditions with a shape that names one kind of failure, and their concerns."""
    gr = graph(spark, d)
    token = F.concat(F.lit("FRF"), (F.floor(c("cid") / 20) % 5 + 1).cast("string"))
    cond = conditions(spark, d).withColumn("shape", F.array(c("shape")[0], token))
    seen = inf.visits(inf.scored_projects(cond, gr.nodes, gr.edges), gr.edges)
    damp = F.when(F.exists("shape", lambda x: x.contains("AUTO")) & c("title").rlike("3$"), 0.1).otherwise(0.0)
    found = settle(inf.concerns(seen, cond, gr.nodes, gr.edges, severity(), extra=damp))
    found = found.join(inf.labels_behind(found, seen, gr.nodes, gr.edges), ["cid", "fm"])
    held = lambda pattern: F.exists("shape", lambda x: x.rlike(pattern))
    on = F.array_compact(F.array(F.when(held("BUILD|MACH"), "urgent"), F.when(c("light").rlike("(?i)LED"), "light"), F.when(held("AUTO"), "closed")))
    active = cond.select("cid", F.explode(on).alias("rule"))
    return found, inf.cause_findings(found, active, gr.nodes, gr.edges, RULES, severity())


@query(g(_CHECK + " select cid, anchor, category, severity, confidence, trace, list_distinct(evidence) is not null as proven, len(list_distinct(evidence)) as proofs, row_number() over (partition by cid order by confidence desc, severity desc, late, turn, anchor) as place, count(*) over (partition by cid) as total from every qualify place <= 8"))
def g15_checklist(spark, d) -> DataFrame:
    """The eight most certain findings of each condition: failure modes of like projects, and causes that its shape and light weigh."""
    found = inf.checklist(*checked(spark, d))
    return found.select("cid", "anchor", "category", "severity", "confidence", "trace", c("evidence").isNotNull().alias("proven"), F.size("evidence").cast("long").alias("proofs"), "place", "total")


@query(g(_CHECK + " select cid, anchor, category, severity, confidence, trace, evidence from causes"))
def g15_cause_findings(spark, d) -> DataFrame:
    """The causes among them, with what they lead back to."""
    return checked(spark, d)[1].select("cid", "anchor", "category", "severity", "confidence", "trace", "evidence")


@query(
    g(""", o as (select dst as fm, src, ord, row_number() over (partition by dst order by ord) as n from edges where rel = 'OCCURRED_IN'), p as (select fm, list(src || '→OCCURRED_IN→' || fm order by n) as t, list(n2.label order by n) as l from o join nodes n2 on n2.id = src where n <= 3 group by fm)
    select e.src as cid, e.dst as fm, 10 - cast(substr(e.dst, 4, 1) as int) as severity, cast(floor((0.4::double * 0.9::double + 0.3::double * ((10 - cast(substr(e.dst, 4, 1) as int)) / 10.0::double)) * 100 + 0.5) as int) as confidence,
      list_concat([e.src || '→HAS_FAILURE→' || e.dst], coalesce(t, [])) as trace, coalesce(l, []) as occurred from edges e left join p on p.fm = e.dst where e.rel = 'HAS_FAILURE'""")
)
def g16_item_concerns(spark, d) -> DataFrame:
    """The same with every part as an anchor, and the projects in which its failure modes occurred."""
    gr = graph(spark, d)
    items = table(spark, d, "part").select(F.concat(F.lit("IP"), c("p_partkey").cast("string")).alias("id"))
    cond = items.select(c("id").alias("cid"), F.lit("").alias("market"), F.array().cast("array<string>").alias("shape"))
    found = inf.concerns(inf.item_visits(items.select(c("id").alias("cid"), "id"), gr.edges), cond, gr.nodes, gr.edges, severity(), rel="HAS_FAILURE")
    past = inf.occurrences(gr.nodes, gr.edges).select("fm", c("trace").alias("more"), c("evidence").alias("occurred"))
    none = F.array().cast("array<string>")
    found = found.join(past, "fm", "left")
    return found.select("cid", "fm", "severity", "confidence", F.concat("trace", F.coalesce("more", none)).alias("trace"), F.coalesce("occurred", none).alias("occurred"))


@query(
    g(", cond as (select c_custkey as cid, c_mktsegment as seg from customer where c_custkey % 20 = 0), rules as (select * from (values ('slim', 'BUILD|MACH', '^[12]-'), ('sealed', 'AUTO', 'LOW|NOT')) t(rule, shape, label)),"
      " first_fm as (select dst as cause, min_by(src, ord) as fm from edges where rel = 'CAUSED_BY' group by dst) select cid, rule, f.cause, f.fm from cond, rules, first_fm f join nodes n on n.id = f.cause where regexp_matches(seg, rules.shape) and regexp_matches(n.label, rules.label)")
)
def g14_cause_concerns(spark, d) -> DataFrame:
    gr = graph(spark, d)
    return inf.cause_concerns(conditions(spark, d), gr.nodes, gr.edges, {"slim": ("BUILD|MACH", "^[12]-"), "sealed": ("AUTO", "LOW|NOT")})


@query(
    """with r as (select p_partkey as id, unnest([p_name, p_type || ' steel', '10 99']) as item from part), x as (select p_partkey as id, lower(p_name || ' ' || p_type) as text from part where p_partkey % 4 <> 0),
    t as (select r.id, item, list_filter(regexp_split_to_array(lower(item), '\\s+'), lambda t: length(t) >= 2 and not regexp_matches(t, '^[0-9]')) as t, coalesce(text, '') as text from r left join x on x.id = r.id),
    q as (select id, item, case when len(t) > 0 then len(list_filter(t, lambda w: contains(text, w))) / len(t)::double else 0.0 end as ratio from t)
    select id, list_sort(coalesce(list(item) filter (where ratio >= 1), [])) as covered, list_sort(coalesce(list(item) filter (where ratio > 0 and ratio < 1), [])) as unknown, list_sort(coalesce(list(item) filter (where ratio = 0), [])) as missing from q group by id"""
)
def a9_coverage(spark, d) -> DataFrame:
    """Required items as covered, unknown or missing; also the master audit."""
    part = table(spark, d, "part")
    required = part.select(c("p_partkey").alias("id"), F.explode(F.array("p_name", F.concat("p_type", F.lit(" steel")), F.lit("10 99"))).alias("item"))
    corpus = part.where("p_partkey % 4 <> 0").select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return inf.coverage(required, corpus)


@query(
    g(""", t as (select id from nodes where id like 'IS%'), targets as (select id from t union select dst from edges where rel = 'CONSISTS_OF' and src in (select id from t)),
    rows as (select h.src as item, h.dst as fm, k.dst as cause, 10 - cast(substr(h.dst, 4, 1) as int) as s, least(10, 3 + length(h.src)) as o, 5 as d, coalesce(n.label, '') as action
      from edges h join targets on targets.id = h.src left join edges k on k.rel = 'CAUSED_BY' and k.src = h.dst left join edges a on a.rel = 'MITIGATED_BY' and a.src = h.dst left join nodes n on n.id = a.dst where h.rel = 'HAS_FAILURE')
    select item, fm, cause, s, o, d, s * o * d as rpn, case when s * o * d >= 125 then 'high' when s * o * d >= 60 then 'middle' else 'low' end as priority, action from rows
    qualify row_number() over (partition by fm, cause order by s * o * d desc, s desc, item) = 1""")
)
def g18_worksheet_draft(spark, d) -> DataFrame:
    """Draft of all suppliers' assemblies."""
    gr = graph(spark, d)
    digit = F.substring("fm", 4, 1).cast("int")
    return inf.worksheet(gr.nodes.where("id like 'IS%'"), gr.nodes, gr.edges, 10 - digit, 3 + F.length("item"), F.lit(5))


_MATERIAL = "case cast(substr(id, 3) as bigint) % 4 when 0 then 65 when 1 then 160 when 2 then 250 end"


@query(
    g(f""", k as (select e.src as item, cte, min(e.dst) as part, count(*) as n from edges e join (select id, {_MATERIAL} as cte from nodes where id like 'IP%') m on m.id = e.dst where e.rel = 'CONSISTS_OF' and cte is not null group by e.src, cte)
    select a.item, a.part as one, b.part as other, b.cte - a.cte as gap, a.n * b.n as pairs, case when b.cte - a.cte >= 150 then 'risk' else 'warn' end as level, cast(least(greatest(floor(50 + (b.cte - a.cte) / 4.0 + 0.5), 50), 95) as int) as confidence from k a join k b on a.item = b.item and a.cte + 80 <= b.cte""")
)
def g19_expansion_gaps(spark, d) -> DataFrame:
    """Materials of parts that expand unlike, for all assemblies."""
    gr = graph(spark, d)
    m = F.substring("id", 3, 30).try_cast("long") % 4
    material = F.when(~c("id").startswith("IP"), None).when(m == 0, "PC").when(m == 1, "EPDM").when(m == 2, "실리콘").otherwise("steel")
    return inf.expansion_gaps(gr.nodes, gr.edges, material)


@query(
    g(""", m as (select id as part, label, list_filter(props, lambda p: p.k = 'material')[1].v as mat from nodes where id like 'IP%'),
    own as (select src as item, dst as part from edges where rel = 'CONSISTS_OF'), fail as (select src as part, dst as fm from edges where rel = 'HAS_FAILURE' and regexp_matches(dst, '[124]$')),
    why as (select src as fm, min_by(dst, ord) as cause from edges where rel = 'CAUSED_BY' and not (src like 'F%4') group by src),
    doc as (select src as part, n.label as file from edges e join nodes n on n.id = e.dst where e.rel = 'EVIDENCED_BY')
    select item, 'history' as rule, 'warn' as level, part, fm, cause, case when cause is null then 65 else 78 end as confidence,
      list_filter([item || '→CONSISTS_OF→' || part, part || '→HAS_FAILURE→' || fm, fm || '→CAUSED_BY→' || cause], lambda x: x is not null) as trace,
      list_filter([m.label || ': ' || mat, fm, (select label from nodes where id = cause), file], lambda x: x is not null) as evidence
    from own join fail using (part) join m using (part) left join why using (fm) left join doc using (part)""")
)
def g19_material_history(spark, d) -> DataFrame:
    """Parts whose material goes with failures of three kinds, for all items; failures of the fourth kind have no cause here."""
    gr = graph(spark, d)
    edges = gr.edges.where("not (rel = 'CAUSED_BY' and src like 'F%4')")
    material = F.transform(F.filter("props", lambda p: p["k"] == "material"), lambda p: p["v"])
    return parts.material_histories(gr.nodes, edges, material, "[124]$")


_CLOSED = """, n2 as (select id, type, label, case when id like 'IS%' and ord % 3 = 0 then 'sealed' when id like 'IN%' and ord % 4 = 1 then 'sealed' else sub end as sub, props from nodes)"""


@query(
    g(_CLOSED + """, kid as (select e.src as item, e.dst as part, e.ord, n.label, regexp_matches(n.label, 'gadget') or regexp_matches(coalesce(n.sub, ''), 'gadget') or len(list_filter(n.props, lambda p: regexp_matches(p.v, '^9[05]5$'))) > 0 as vent from edges e join n2 n on n.id = e.dst where e.rel = 'CONSISTS_OF'),
    p as (select item, count(*) as n_parts from kid group by item having not bool_or(vent)), f as (select item, list({'part': part, 'label': label} order by ord) as ps from (select * from kid qualify row_number() over (partition by item order by ord) <= 8) group by item),
    src as (select e.dst as item, min_by(e.src, e.ord) as source, min_by(e.rel, e.ord) as rel, min_by(n.label, e.ord) as label from edges e join n2 n on n.id = e.src and n.sub = 'sealed' group by e.dst)
    select item, 'closed' as rule, 'risk' as level, case when n.sub = 'sealed' then null else source end as source, n_parts, 80 as confidence,
      list_concat(case when n.sub = 'sealed' then [] else [source || '→' || rel || '→' || item] end, list_transform(ps, lambda p: item || '→CONSISTS_OF→' || p.part)) as trace,
      (select list(x order by i) from (select x, min(i) as i from (select unnest(list_concat([case when n.sub = 'sealed' then n.label else src.label end], list_transform(ps, lambda p: p.label))) as x, generate_subscripts(list_concat(['' ], ps_labels), 1) as i) group by x)) as evidence
    from p join n2 n on n.id = item and n.type = 'item' join (select *, list_transform(ps, lambda p: p.label) as ps_labels from f) f using (item) left join src using (item) where n.sub = 'sealed' or source is not null""")
)
def g19_closed_without_vent(spark, d) -> DataFrame:
    """Closed items without a vent part; a third of the suppliers and a quarter of the nations are closed, gadgets and two prices stand for vents."""
    gr = graph(spark, d)
    closed = (c("id").startswith("IS") & (c("ord") % 3 == 0)) | (c("id").startswith("IN") & (c("ord") % 4 == 1))
    nodes = gr.nodes.withColumn("sub", F.when(closed, "sealed").otherwise(c("sub")))
    return parts.closed_without_vent(nodes, gr.edges, "^sealed$", "gadget|^9[05]5$")


def features():
    """A shape from the columns of a part."""
    return F.struct(
        (c("p_size") % 4).alias("vent_count"),
        F.when(c("p_size") % 2 == 0, "up, down").otherwise("up").alias("vent_layout"),
        c("p_brand").alias("seal"),
        c("p_type").alias("housing"),
        F.concat(F.lit("IP"), (c("p_size") % 9).cast("string")).alias("connector"),
        F.when(c("p_partkey") % 3 == 0, c("p_brand")).alias("gasket"),
        F.split(c("p_name"), " ")[1].alias("lens"),
    )


@query(
    """with f as (select p_partkey as id, p_name, p_size % 4 as vc, case when p_size % 2 = 0 then 'up,down' else 'up' end as vl, lower(p_brand) as seal, lower(p_type) as housing, p_size % 9 as ip, case when p_partkey % 3 = 0 then lower(p_brand) end as gasket, split_part(p_name, ' ', 2) as lens from part),
    p as (select a.id, b.id as other, (case abs(a.vc - b.vc) when 0 then 1.0 when 1 then 0.4 else 0.0 end * 0.6 + case when a.vl = b.vl then 1.0 else 0.5 end * 0.4) * 0.25 as w1, case when a.seal = b.seal then 0.2 when contains(a.seal, b.seal) or contains(b.seal, a.seal) then 0.2 / 2 else 0 end as w2, case when a.housing = b.housing then 0.2 when contains(a.housing, b.housing) or contains(b.housing, a.housing) then 0.2 / 2 else 0 end as w3,
      case when a.ip = b.ip then 0.15 when abs(a.ip - b.ip) <= 1 then 0.075 else 0 end as w4, case when a.gasket = b.gasket then 0.1 when contains(a.gasket, b.gasket) or contains(b.gasket, a.gasket) then 0.1 / 2 else 0 end as w5, case when a.gasket is not null and b.gasket is not null then 0.1 else 0 end as g5, case when a.lens = b.lens then 0.1 else 0 end as w6 from f a join f b on a.p_name = b.p_name and a.id <> b.id where a.id % 10 = 0),
    s as (select id, other, floor(round(((w1 + w2 + w3 + w4 + w5 + w6) / (0.9 + g5))::double * 100 + 0.5, 9)) / 100 as score from p)
    select id, other, score, row_number() over (partition by id order by score desc, other) as place from s where score > 0.3 qualify place <= 4"""
)
def g7_shape_similarity(spark, d) -> DataFrame:
    """Four most similar shapes among the parts of one name, for every tenth part."""
    rows = table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_name").alias("kind"), features().alias("features"), c("p_partkey").alias("ord"))
    return shapes.most_alike(rows.where("id % 10 = 0"), rows, 4).where("score > 0.3").select("id", "other", "score", "place")


@query(
    """with r as (select r_name as region, count(distinct n_nationkey) as nations, count(distinct c_custkey) as projects, list_sort(list(distinct c_mktsegment)) as segments from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name) select * from r"""
)
def g21_region_lookup(spark, d) -> DataFrame:
    """What is known of each region: its size, projects and segments."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), c("n_regionkey") == c("r_regionkey")).join(table(spark, d, "customer"), c("n_nationkey") == c("c_nationkey"), "left")
    return places.groupBy(c("r_name").alias("region")).agg(F.count_distinct("n_nationkey").alias("nations"), F.count_distinct("c_custkey").alias("projects"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query(g(_CONCERN + " select 'conditions' as step, count(*) as n from cond union all select 'projects', count(*) from proj union all select 'visits', count(*) from v union all select 'concerns', count(*) from found"))
def g22_pipeline_log(spark, d) -> DataFrame:
    """Rows after each step of the inference, observed while it runs once."""
    gr = graph(spark, d)
    cond = settle(conditions(spark, d))
    steps = {name: Observation(name) for name in ("projects", "visits", "concerns")}
    watched = lambda df, name: df.observe(steps[name], F.count(F.lit(1)).alias("n"))
    seen = watched(inf.visits(watched(inf.scored_projects(cond, gr.nodes, gr.edges), "projects"), gr.edges), "visits")
    watched(seen.select("cid", "fm").distinct(), "concerns").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("conditions", cond.count()), *((name, o.get["n"]) for name, o in steps.items())], "step string, n long")


@query("select event_type as metric, round(avg(case when event_id % 7 <> 0 then value end), 6) as mean, count(*) filter (where event_id % 7 = 0) as failed, count(*) as questions from events group by event_type")
def a10_evaluation_report(spark, d) -> DataFrame:
    """Means of metrics over the answers that have a value; the others count as failed."""
    value = F.when(c("event_id") % 7 != 0, c("value")).otherwise(F.lit(float("nan")))
    rows = table(spark, d, "events").select(c("event_type").alias("metric"), F.when(~F.isnan(value), value).alias("v"))
    return rows.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count_if(c("v").isNull()).alias("failed"), F.count("*").alias("questions"))
