"""Queries on worksheets, decks, reports and model answers built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import office
from kgspark.sources.tables import table

from .functions import _FNV
from .registry import query

c = F.col
ROLES = [("item", "part name", 0), ("fm", "failure mode", 0), ("cause", "root cause", 0)]


def _name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), c(column).cast("string"))


@query("select o_custkey as file, o_custkey % 4 + 1 + o_orderkey as r, 'IP' || o_orderkey % 97 as item, 'F' || o_orderstatus as fm, 'C' || o_orderpriority as cause from orders where o_orderkey % 10 <> 0")
def i9_worksheet_rows(spark, d) -> DataFrame:
    """Rows of one worksheet per customer under a header at differing heights; rows without a failure mode go."""
    cell = lambda r, col, v: F.struct(r.cast("long").alias("r"), F.lit(col).alias("c"), v.alias("value"))
    top, below = c("c_custkey") % 4, c("o_custkey") % 4 + 1 + c("o_orderkey")
    head = F.array(cell(top, 0, F.lit("Part Name")), cell(top, 1, F.lit("Failure-Mode")), cell(top, 2, F.lit("Root cause (main)")))
    fm = F.when(c("o_orderkey") % 10 != 0, _name("F", "o_orderstatus")).otherwise(" ")
    item = F.concat(F.lit("IP"), (c("o_orderkey") % 97).cast("string"))
    body = F.array(cell(below, 0, item), cell(below, 1, fm), cell(below, 2, _name("C", "o_orderpriority")))
    heads = table(spark, d, "customer").select(c("c_custkey").alias("file"), F.explode(head).alias("e"))
    cells = heads.unionByName(table(spark, d, "orders").select(c("o_custkey").alias("file"), F.explode(body).alias("e")))
    cells = cells.select("file", F.lit("s").alias("sheet"), "e.*")
    return office.worksheet_rows(cells, spark.createDataFrame(ROLES, "role string, synonym string, ord int"), ("item", "fm", "cause")).drop("sheet")


@query(
    """with k as (select c_custkey as doc, 'P' || c_nationkey as item, 'F' || c_custkey % 9 as fm, c_custkey % 4 as m from customer)
    select doc, item as src, 'HAS_FAILURE' as rel, fm as dst from k where m <> 1 union all select doc, fm, 'CAUSED_BY', 'wet seal ' || m from k union all select doc, fm, 'MITIGATED_BY', 'dry it' from k where m <> 2"""
)
def i10_deck_links(spark, d) -> DataFrame:
    """Decks with a cover, a slide of causes and one of actions; some lack the part or the actions."""
    m = c("c_custkey") % 4
    line = lambda s, n, v: F.struct(F.lit(s).alias("slide"), F.lit(n).alias("line"), v.alias("text"))
    part = F.when(m == 1, "no part").otherwise(_name("part: P", "c_nationkey"))
    issue = F.concat(F.lit("issue:F"), (c("c_custkey") % 9).cast("string"))
    causes = [F.lit("causes"), F.concat(F.lit("wet seal "), m.cast("string")), F.lit("1. numbered"), F.lit("key: value"), F.lit("A sentence."), F.lit("a line that is longer than thirty characters")]
    actions = [F.when(m == 2, "other").otherwise("actions"), F.lit("dry it"), F.lit("later")]
    lines = F.array(line(0, 0, F.lit("cover")), line(0, 1, part), line(0, 2, issue), line(0, 3, F.lit("issue: second")), *(line(1, i, v) for i, v in enumerate(causes)), *(line(2, i, v) for i, v in enumerate(actions)), line(3, 0, F.lit("causes")), line(3, 1, F.lit("late cause")))
    rows = table(spark, d, "customer").select(c("c_custkey").alias("doc"), F.explode(lines).alias("e")).select("doc", "e.*")
    return office.deck_links(rows, "part:", "issue:", "causes", "actions")


@query(
    """with k as (select o_orderkey as doc, 'P' || o_custkey as item, case when o_orderkey % 3 <> 0 then 'F' || o_orderkey % 7 end as fm, case when o_orderkey % 5 <> 0 then 'C' || o_orderpriority end as cause from orders)
    select doc, item as src, 'HAS_FAILURE' as rel, fm as dst from k where fm is not null union all select doc, fm, 'CAUSED_BY', cause from k where fm is not null and cause is not null union all select doc, coalesce(fm, cause), 'MITIGATED_BY', 'A' || doc % 11 from k where coalesce(fm, cause) is not null"""
)
def i11_report_links(spark, d) -> DataFrame:
    """Reports of keyed paragraphs, the last of equal keys counting; blank fields give no link."""
    k = c("o_orderkey")
    fm = F.when(k % 3 != 0, F.concat(F.lit("mode: F"), (k % 7).cast("string"))).otherwise("mode: ")
    cause = F.when(k % 5 != 0, F.concat(F.lit("cause :C"), c("o_orderpriority"))).otherwise("because of nothing")
    lines = F.array(F.lit("Report"), F.lit("mode: overwritten"), _name("part： P", "o_custkey"), fm, cause, F.concat(F.lit("action: A"), (k % 11).cast("string")))
    rows = table(spark, d, "orders").select(k.alias("doc"), F.posexplode(lines).alias("pos", "text"))
    return office.report_links(rows, {"item": "part", "fm": "mode", "cause": "cause", "action": "action"})


def answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Answers on orders: line items with real, invented or no ids, each related to the line before; and the parts."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = lines.join(table(spark, d, "part").select("p_partkey", "p_name"), c("p_partkey") == c("l_partkey"))
    n = c("l_linenumber")
    given = F.when(n % 3 == 1, _name("IP", "l_partkey")).when(n % 3 == 2, _name("XX", "l_partkey"))
    label = lambda line: F.concat(F.lit("New "), line.cast("string"))
    entity = F.struct(F.when(n == 6, "other").otherwise("item").alias("type"), given.alias("id"), F.when(n == 5, c("p_name")).otherwise(label(n)).alias("label"))
    relation = F.struct(label(n).alias("srcLabel"), F.when(n == 4, "MADE_UP").otherwise("CONSISTS_OF").alias("rel"), label(n - 1).alias("dstLabel"))
    sort = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), x.alias("x")))), lambda e: e["x"])
    records = rows.groupBy(c("l_orderkey").alias("doc")).agg(sort(entity).alias("entities"), sort(relation).alias("relations"))
    parts = table(spark, d, "part").select(_name("IP", "p_partkey").alias("id"), F.lit("item").alias("type"), c("p_name").alias("label"), c("p_partkey").alias("ord"))
    return records, parts


_ANSWERS = f"""with first as (select regexp_replace(p_name, ' ', '', 'g') as k, 'IP' || min(p_partkey) as id from part group by 1),
 e as (select l_orderkey as doc, l_linenumber as n, 'IP' || l_partkey as part, p_name, 'AUTO_item_' || {_FNV.format("'new' || l_linenumber")} as made from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by all) join part on p_partkey = l_partkey where l_linenumber <> 6),
 f as (select doc, n, case when n % 3 = 1 then part when n = 5 then first.id else made end as id from e join first on k = regexp_replace(p_name, ' ', '', 'g'))"""


@query(_ANSWERS + " select distinct doc, f.id, 'item' as type, coalesce(p_name, 'New ' || n) as label, p_name is null as new from f left join part on 'IP' || p_partkey = f.id")
def i14_delta_nodes(spark, d) -> DataFrame:
    """Nodes that answers name: by a real id, by a known label, or new."""
    return office.extraction_delta(*answers(spark, d), ["item"], ["CONSISTS_OF"])[0]


@query(
    _ANSWERS
    + " select distinct a.doc, a.id as src, 'CONSISTS_OF' as rel, b.id as dst from f a join f b on a.doc = b.doc and b.n = a.n - 1 where a.n not in (4, 5) and b.n <> 5 and a.id <> b.id union all select distinct doc, id, 'EVIDENCED_BY', cast(doc as varchar) from f where id like 'AUTO%'"
)
def i14_delta_edges(spark, d) -> DataFrame:
    """Relations of answers bound by label, and the evidence of new nodes."""
    return office.extraction_delta(*answers(spark, d), ["item"], ["CONSISTS_OF"])[1]


@query("select l_orderkey as file, count(*) as relations, count(distinct l_partkey) + count(distinct l_suppkey) as objects from lineitem group by l_orderkey")
def a11_extraction_summary(spark, d) -> DataFrame:
    """Objects and asserted relations per file."""
    links = table(spark, d, "lineitem").select(c("l_orderkey").alias("file"), _name("IS", "l_suppkey").alias("src"), F.lit("CONSISTS_OF").alias("rel"), _name("IP", "l_partkey").alias("dst"))
    return office.extraction_summary(links)


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' — ' || p_brand || '/한글'), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') as slug from part")
def f6_slug(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" — "), "p_brand", F.lit("/한글"))).alias("slug"))


@query("select doc_id, 'passage: ' || text as passage, 'query: ' || source as question from documents")
def f24_prefixed(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.prefixed(c("text")).alias("passage"), text.prefixed(c("source"), "query").alias("question"))
