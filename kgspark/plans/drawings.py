"""Queries on drawings: one for every order, with its lines as the parts list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import drawings as dw
from kgspark.operators import questions as qs
from kgspark.sources.tables import graph, table

from .graph import g
from .registry import query

c = F.col

_MARKETS = "case k % 5 when 0 then '동남아' when 1 then '유럽' when 2 then '중국' else '북미' end"


def texts(spark, d) -> DataFrame:
    """Texts of the drawings: labels, features, a note, vents and a light, the parts list and, in a quarter of them, a line below it."""
    orders, lines = table(spark, d, "orders").select(c("o_orderkey").alias("k")), table(spark, d, "lineitem")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")))
    pick = lambda n, *values: F.coalesce(*(F.when(c("k") % n == i, v) for i, v in enumerate(values)))
    line = lambda i, x, y, value: F.struct(F.lit(i).alias("entity"), F.lit(float(x)).alias("x"), (y if not isinstance(y, int) else F.lit(y)).cast("double").alias("y"), value.alias("value"))
    said = F.array(
        line(1, 0, 200, F.concat(F.lit("부품명: A"), "k")),
        line(2, 0, 195, F.concat(F.lit("프로젝트 : P"), c("k") % 7)),
        line(3, 0, 190, F.concat(F.lit("1. 하우징: "), pick(2, "밀폐형", "개방형"))),
        line(4, 0, 185, F.concat(F.lit("2) 벤트 홀: "), c("k") % 3, F.lit(" (상)"))),
        line(5, 0, 180, F.lit("3. check the seal")),
        line(6, 0, 175, F.concat(F.lit("커넥터: IP"), 60 + c("k") % 10)),
        line(7, 0, 170, F.concat(F.lit("소재: "), pick(3, "PC", "PA6", "PMMA"))),
        line(8, 0, 165, F.concat(F.lit("개스킷 소재: "), pick(2, "EPDM", "실리콘"))),
        line(9, 0, 160, F.lit("소재: second")),
        line(10, 300, 300, F.lit("LED module")),
        line(11, 320, 300 - c("k") % 60, F.lit("VENT A")),
        line(12, 330, 310, F.lit("vent B")),
        *(line(13 + i, 500 + 20 * i, 100, F.lit(h)) for i, h in enumerate(dw.HEADERS)),
    )
    fixed = orders.select(c("k").alias("file"), F.inline(said))
    n, y = c("n"), 100 - 5 * c("n") - c("n") % 2
    cell = lambda i, x, value: F.struct((100 + 10 * n + i).alias("entity"), F.lit(float(x)).alias("x"), (y + (i % 2)).cast("double").alias("y"), value.cast("string").alias("value"))
    cells = F.array(cell(0, 501, n), cell(1, 519, F.concat(F.lit("part"), "l_partkey")), cell(2, 541, F.floor("l_quantity")), cell(3, 570, c("l_returnflag")))
    last = orders.where("k % 4 = 0").select(c("k").alias("file"), F.lit(900).alias("entity"), F.lit(500.0).alias("x"), F.lit(-1000.0).alias("y"), F.lit("end").alias("value"))
    return fixed.unionByName(lines.select(c("l_orderkey").alias("file"), F.inline(cells))).unionByName(last)


_FACTS = """with o as (select o_orderkey as k from orders), f as (
 select k as file, 'label' as what, '부품명' as key, 'A' || k as v from o union all select k, 'label', '프로젝트', 'P' || k % 7 from o union all select k, 'feature', '하우징', case k % 2 when 0 then '밀폐형' else '개방형' end from o
 union all select k, 'feature', '벤트 홀', k % 3 || ' (상)' from o union all select k, 'feature', '커넥터', 'IP' || 60 + k % 10 from o union all select k, 'label', '소재', case k % 3 when 0 then 'PC' when 1 then 'PA6' else 'PMMA' end from o
 union all select k, 'feature', '개스킷 소재', case k % 2 when 0 then 'EPDM' else '실리콘' end from o),
 b as (select l_orderkey as file, n as row, cast(n as varchar) as no, 'part' || l_partkey as name, cast(cast(floor(l_quantity) as bigint) as varchar) as qty, l_returnflag as material from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_returnflag) as n from lineitem))"""


@query(_FACTS + " select file, what, key, v from f union all select k, 'note', 'entity 5', 'check the seal' from o")
def i12_drawing_facts(spark, d) -> DataFrame:
    """Labels, features and notes of all drawings."""
    rows = texts(spark, d)
    note = dw.notes(rows).select("file", F.lit("note").alias("what"), F.concat(F.lit("entity "), c("entity").cast("string")).alias("key"), c("note").alias("v"))
    return dw.keyed(rows).select("file", "what", c("k").alias("key"), "v").unionByName(note)


@query(_FACTS + " select file, row, no, name, qty, material from b")
def i12_parts_lists(spark, d) -> DataFrame:
    """Parts lists of all drawings."""
    return dw.parts_lists(texts(spark, d))


@query(
    _FACTS + """ select file, 'prop' as what, 'A' || file as one, '소재' as two, v as three from f where key = '소재' union all select file, 'prop', 'P' || file % 7, '형상.' || key, v from f where what = 'feature'
    union all select distinct file, 'prop', name, '재질', material from b union all select distinct file, 'edge', 'A' || file, 'CONSISTS_OF', name from b"""
)
def i12_drawing_graph(spark, d) -> DataFrame:
    """What the drawings add to the graph, before names are resolved."""
    rows = texts(spark, d)
    props, links = dw.drawing_graph(dw.keyed(rows), dw.parts_lists(rows))
    told = lambda df, what, *names: df.select("file", F.lit(what).alias("what"), *(c(n).alias(a) for n, a in zip(names, ("one", "two", "three"))))
    return told(props, "prop", "name", "k", "v").unionByName(told(links, "edge", "src", "rel", "dst"))


@query(
    _FACTS + f""", m as (select k, {_MARKETS} as market, case k % 3 when 0 then 65 when 1 then 80 else 70 end as a, case k % 2 when 0 then 160 else 250 end as b, 60 + k % 10 as ip, k % 3 as vents from o)
    select k as file, 'expansion' as rule, '주의' as level, (b - a) || ': ' || a || ', ' || b as detail from m where b - a >= 80
    union all select k, 'vent-heat', '주의', case when sqrt(20.0 * 20 + (k % 60) * (k % 60)) < 45 then 'VENT A·vent B' else 'vent B' end from m
    union all select k, 'grade', case when ip < 66 then '높음' else '주의' end, 'IP' || ip || ', ' || market from m where market in ('동남아', '중국')
    union all select k, 'vents', '높음', '밀폐형, ' || vents from m where k % 2 = 0 and vents <= 1"""
)
def g20_drawing_risks(spark, d) -> DataFrame:
    """The four rules on all drawings."""
    rows, k = texts(spark, d), c("o_orderkey")
    markets = table(spark, d, "orders").select(k.alias("file"), F.when(k % 5 == 0, "동남아").when(k % 5 == 1, "유럽").when(k % 5 == 2, "중국").otherwise("북미").alias("market"))
    return dw.risks(rows, dw.keyed(rows), markets)


def shaped(spark, d) -> DataFrame:
    """Projects with shape features."""
    k = c("c_custkey")
    text = lambda col: col.cast("string")
    features = F.struct(
        (k % 4).cast("int").alias("vent_count"), F.when(k % 2 == 0, "up").otherwise("down").alias("vent_layout"), c("c_mktsegment").alias("seal"), F.concat(F.lit("H"), text(c("c_nationkey"))).alias("housing"),
        F.concat(F.lit("IP"), text(k % 9)).alias("connector"), F.when(k % 3 == 0, c("c_mktsegment")).alias("gasket"), F.concat(F.lit("L"), text(k % 2)).alias("lens"),
    )
    return table(spark, d, "customer").select(F.concat(F.lit("PJ"), k).alias("id"), features.alias("features"), k.alias("ord"))


_LIKE = """, s as (select c_custkey as k, c_mktsegment as seg, c_nationkey as nat from customer), p as (select a.k, b.k as o,
      (case abs(a.k % 4 - b.k % 4) when 0 then 1.0 when 1 then 0.4 else 0.0 end * 0.6 + case when a.k % 2 = b.k % 2 then 0.4 else 0.0 end) * 0.25 as w1, case when a.seg = b.seg then 0.2 else 0.0 end as w2,
      case when a.nat = b.nat then 0.2 when contains('H' || a.nat, 'H' || b.nat) or contains('H' || b.nat, 'H' || a.nat) then 0.1 else 0.0 end as w3, case when a.k % 9 = b.k % 9 then 0.15 when abs(a.k % 9 - b.k % 9) <= 1 then 0.075 else 0.0 end as w4,
      case when a.k % 3 = 0 and b.k % 3 = 0 then 0.1 else 0.0 end as g5, case when a.k % 3 = 0 and b.k % 3 = 0 and a.seg = b.seg then 0.1 else 0.0 end as w5, case when a.k % 2 = b.k % 2 then 0.1 else 0.0 end as w6 from s a join s b on a.k <> b.k where a.k % 100 = 0),
    r as (select *, floor(round(((w1 + w2 + w3 + w4 + w5 + w6) / (0.9 + g5))::double * 100 + 0.5, 9)) / 100 as score from p), t as (select k, o, score, row_number() over (partition by k order by score desc, o) as place from r where score > 0 qualify place <= 4)"""


@query(
    g("""""" + _LIKE + """,
    h as (select src, dst as fm, row_number() over (partition by src order by case when substr(dst, 4, 1) = '1' then 0 else 1 end, ord) as n from edges where rel = 'OCCURRED_IN')
    select 'PJ' || k as id, 'PJ' || o as other, score, place, score > 0.3 as linked, coalesce((select list(fm order by n) from h where src = 'PJ' || o and n <= 3), []) as fms from t""")
)
def g8_similar_history(spark, d) -> DataFrame:
    """The four most similar projects for every hundredth one, whether they become links, and what occurred in them."""
    gr, rows = graph(spark, d), shaped(spark, d)
    found = dw.similar_projects(rows.where("ord % 100 = 0"), rows)
    links = dw.similar_edges(found).select(c("src").alias("id"), c("dst").alias("other"), F.lit(True).alias("linked"))
    past = dw.histories(found.select(c("other").alias("id")), gr.nodes, gr.edges, F.substring("label", 4, 1) == "1").withColumnRenamed("id", "other")
    rows = found.join(links, ["id", "other"], "left").join(past, "other", "left")
    return rows.select("id", "other", "score", "place", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("fms", F.array().cast("array<string>")).alias("fms"))


@query(
    """with m as (select conv_id, turn, lower(trim(text)) as qn, regexp_replace(lower(text), '\\s+', '', 'g') as qns from conversations),
    men as (select c_custkey as ord, c_name as label, c_mktsegment as symptom, 'x' || c_nationkey as detail, c_custkey % 3 <> 2 as recorded from customer where c_custkey % 50 = 1),
    first as (select *, row_number() over (order by recorded, ord) as n from men), l as (select string_agg(label || ' "' || symptom || '" ' || detail, ' · ' order by n) as listed from first where n <= 3), g as (select * from first where n = 1)
    select conv_id, turn, '네 — 커뮤니티 언급이 있습니다: ' || listed || '. ' || case when not g.recorded then '주목할 모순: **' || g.label || '**는 FMEA 기록상 결로·습기 이력이 없는데 커뮤니티에 "' || g.symptom || '" 언급(' || g.detail || ')이 있습니다 — 내부 기록과 실사용 간 괴리로, 필드 신호가 품질 데이터에 아직 반영되지 않았을 가능성이 있습니다.'
      else '언급된 프로젝트들은 모두 FMEA 결로 이력과 정합합니다.' end as answer, '의도: 소비자 반응 교차(내부 기록 대조) · 언급 ' || (select count(*) from men) || '건' as interpretation
    from m, l, g where qns <> '' and regexp_matches(qns, 'the')"""
)
def t10_consumer_answers(spark, d) -> DataFrame:
    """What consumers mention, for every turn that asks ("the" stands for it)."""
    turns = table(spark, d, "conversations").select(F.lit("main").alias("canvas_id"), F.struct("conv_id", "turn").alias("qid"), c("text").alias("q"))
    k = c("c_custkey")
    mentions = table(spark, d, "customer").where(k % 50 == 1).select(
        F.lit("main").alias("canvas_id"), c("c_name").alias("label"), c("c_mktsegment").alias("symptom"), F.concat(F.lit("x"), c("c_nationkey").cast("string")).alias("detail"), (k % 3 != 2).alias("recorded"), k.alias("ord")
    )
    found = qs.consumer_answers(qs.asking(turns, "the"), mentions)
    return found.select("qid.conv_id", "qid.turn", "answer", "interpretation")


@query(
    g(_LIKE + """, top as (select *, count(*) over (partition by k) as candidates from t where place <= 3 qualify place = 1),
    q as (select conv_id, turn, conv_id * 100 % (select max(c_custkey) // 100 * 100 + 100 from customer) as k, regexp_matches(lower(text), 'and') as wet from conversations where regexp_matches(regexp_replace(lower(text), '\\s+', '', 'g'), 'the')),
    st as (select src, dst, row_number() over (partition by src order by ord) as n from edges where rel = 'OCCURRED_IN'), h as (select src, string_agg(dst, ', ' order by n) filter (where n <= 3) as firsts, arg_min(dst, n) filter (where dst like '%1') as damp from st group by src),
    x as (select a.k as ak, b.k as bk, list_filter([case when a.k % 4 = b.k % 4 then 'vent' end, case when a.seg = b.seg then 'seal' end, case when a.nat = b.nat then 'housing' end, case when a.k % 9 = b.k % 9 then 'connector' end, case when a.k % 3 = 0 and b.k % 3 = 0 and a.seg = b.seg then 'gasket' end, case when a.k % 2 = b.k % 2 then 'lens' end], lambda v: v is not null) as m from top join s a on a.k = top.k join s b on b.k = top.o)
    select conv_id, turn, rtrim('[기준: ' || na.label || ' 도면] 네 — 형상 기준 ' || floor(round(score * 100 + 0.5, 9))::int || '% 유사한 ' || nb.label || '가 있습니다. 일치: ' || array_to_string(m[1:3], ' · ') || '. '
      || case when wet then case when damp is not null then '해당 프로젝트에 **' || damp || '** 발생 이력이 있습니다.' else '해당 프로젝트에 습기 계열 이력은 확인되지 않습니다.' end when firsts is not null then '발생 이력: ' || firsts || '.' else '' end) as answer,
      '의도: 형상 유사 탐색 · 기준: ' || na.label || '(도면) · 후보 ' || candidates || '건' as interpretation
    from q join top on top.k = q.k join x on x.ak = top.k join nodes na on na.id = 'PJ' || top.k join nodes nb on nb.id = 'PJ' || top.o left join h on h.src = 'PJ' || top.o""")
)
def t10_shape_answers(spark, d) -> DataFrame:
    """The project most like a drawing, for every turn that asks; every hundredth project is one, failure modes of the first kind stand for moisture."""
    gr, rows = graph(spark, d), shaped(spark, d)
    turns = table(spark, d, "conversations").select(F.lit("main").alias("canvas_id"), F.struct("conv_id", "turn").alias("qid"), c("text").alias("q"))
    last = rows.agg((F.floor(F.max("ord") / 100) * 100 + 100).alias("m"))
    asked = qs.asking(turns, "the")
    bases = asked.join(F.broadcast(last), F.lit(True)).select("canvas_id", "qid", F.concat(F.lit("PJ"), c("qid.conv_id") * 100 % c("m")).alias("id"))
    found = dw.with_matches(dw.similar_projects(rows.where("ord % 100 = 0"), rows), rows)
    answers = qs.shape_answers(asked, bases, found, gr.nodes, gr.edges, moist="1$", asks_moist="and")
    return answers.select("qid.conv_id", "qid.turn", "answer", "interpretation")
