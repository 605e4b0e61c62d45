"""Queries on chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import chunks as ch
from kgspark.sources.tables import table

from .registry import query


_PROSE = r"""with recursive p as (select doc_id, row_number() over (partition by doc_id order by i) as i, t from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where t <> ''),
    walk as (select doc_id, i, t as cur, t as last, length(t) + 1 as len, cast(null as varchar) as done from p where i = 1
      union all select w.doc_id, p.i, case when w.len + length(p.t) + 1 > LIMIT then w.last || chr(10) || p.t else w.cur || chr(10) || p.t end, p.t,
        case when w.len + length(p.t) + 1 > LIMIT then length(w.last) + length(p.t) + 1 else w.len + length(p.t) + 1 end, case when w.len + length(p.t) + 1 > LIMIT then w.cur end from walk w join p on p.doc_id = w.doc_id and p.i = w.i + 1),
    outs as (select doc_id, i, 0 as tail, done as text from walk where done is not null union all select doc_id, max(i), 1, max_by(cur, i) from walk group by doc_id)
    select doc_id as file, row_number() over (partition by doc_id order by i, tail) - 1 as seq, 'text' as block, text from outs"""


@query(_PROSE.replace("LIMIT", "300"))
def t1_prose_chunks(spark, d) -> DataFrame:
    """All documents in chunks of about 300 characters, numbered within each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return ch.backfill(docs, spark.createDataFrame([], "file long"), most=300)


@query(_PROSE.replace("LIMIT", "800"))
def t3_all_chunks(spark, d) -> DataFrame:
    """All documents in chunks of about 800 characters, numbered within each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return ch.backfill(docs, spark.createDataFrame([], "file long"))


@query(
    """with recursive r as (select o_custkey as file, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey || ' │ ' || o_orderstatus || ' │ ' || o_orderpriority as line from orders),
    h as (select 'key │ status │ priority' as head),
    walk as (select file, i, line as cur, length(head) + length(line) + 1 as len, cast(null as varchar) as done from r, h where i = 1
      union all select w.file, r.i, case when w.len + length(line) + 1 > 120 then line else w.cur || chr(10) || line end, case when w.len + length(line) + 1 > 120 then length(head) + length(line) + 1 else w.len + length(line) + 1 end,
        case when w.len + length(line) + 1 > 120 then w.cur end from walk w join r on r.file = w.file and r.i = w.i + 1, h),
    outs as (select file, i, 0 as tail, done as text from walk where done is not null union all select file, max(i), 1, max_by(cur, i) from walk group by file)
    select file, row_number() over (partition by file order by i, tail) - 1 as seq, 'orders' as block, head || chr(10) || text as text from outs, h"""
)
def t2_table_chunks(spark, d) -> DataFrame:
    """Orders of each customer as table chunks that repeat the header."""
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("c")))).alias("r"))
    head = F.array(F.array(F.lit("key"), F.lit("status"), F.lit("priority")))
    blocks = rows.select("file", F.lit(0).alias("block_no"), F.lit("orders").alias("block"), F.array().cast("array<string>").alias("lines"), F.concat(head, F.transform("r", lambda x: x["c"])).alias("rows"))
    return ch.chunk_blocks(blocks, most=120)


@query("select doc_id from documents where not contains(text, '|') and doc_id % 3 <> 0")
def t4_chunk_backlog(spark, d) -> DataFrame:
    """Documents that still need chunks: those without any, drawings left out; a text of blanks never gets one and so stays."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("doc_id", F.when(F.col("text").contains("|"), ".dxf").otherwise(".txt")).alias("file"), "text")
    done = docs.where("doc_id % 3 = 0").select("file")
    return docs.join(ch.backfill(docs, done, blank=True).select("file"), "file", "left_semi").select("doc_id")


@query(
    """with l as (select conv_id as file, turn as block_no, i as line_no, line from (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from conversations)),
    n as (select *, row_number() over (partition by file order by block_no, line_no) as place, count(*) over (partition by file) as n from l) select file, block_no, line_no, line, case when place = 4 then n - 4 else 0 end as omitted from n where place <= 4"""
)
def k9_capped_lines(spark, d) -> DataFrame:
    """The first four lines of each conversation and how many more there are."""
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("block_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ch.capped_lines(lines, 4)


@query(
    """with v as (select user_id, event_id, case when event_id % 3 = 0 then event_type end as v from events) select event_id, coalesce(v, last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding)) as filled from v"""
)
def k10_fill_down(spark, d) -> DataFrame:
    """Empty cells take the value above them, as vertically merged cells do."""
    v = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("v"))
    above = F.last("v", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return v.select("event_id", above.alias("filled"))
