"""Queries on the file pipeline, backfills and region details."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import pipeline as pl
from kgspark.operators.lineage import shared_folder
from kgspark.sources.tables import table

from .chunks import _PROSE
from .registry import query
from .rules import _PROVEN, g, proven_graph

c = F.col

_FILES = """with f as (select doc_id as doc, case when doc_id % 17 = 0 then '   ' else text end as text, case when doc_id % 19 = 0 then 'broken' end as error, doc_id % 4 as n, doc_id % 23 = 0 as failed from documents),
 s as (select *, case when error is not null then 'failed' when trim(coalesce(text, '')) = '' then 'no text' when failed then 'failed' when n = 0 then 'no entity' else 'done' end as status from f)"""


def extracted(spark, d):
    """Files, a few of them broken or blank, and what was extracted from them: up to three of their first words, related in turn."""
    k = c("doc_id")
    docs = table(spark, d, "documents")
    files = docs.select(k.alias("doc"), F.when(k % 17 == 0, "   ").otherwise(c("text")).alias("text"), F.when(k % 19 == 0, "broken").alias("error"))
    entity = lambda i: F.struct(F.lit("item").alias("type"), F.concat(F.lit(f"e{i} "), c("source")).alias("label"))
    entities = F.slice(F.array(*(entity(i) for i in range(3))), F.lit(1), (k % 4).cast("int"))
    relation = F.struct(F.concat(F.lit("E0-"), c("source")).alias("srcLabel"), F.lit("NEXT").alias("rel"), F.concat(F.lit("e1 "), c("source")).alias("dstLabel"))
    found = docs.select(k.alias("doc"), entities.alias("entities"), F.array(relation).alias("relations"), (k % 23 == 0).alias("failed"))
    return files, found


@query(_FILES + " select doc, status, case when error is null and trim(coalesce(text, '')) <> '' then length(text[1:12000]) end as prompt from s")
def i17_pipeline_status(spark, d) -> DataFrame:
    """Why files were passed over, and how much of their text the extraction got."""
    return pl.passed_over(*extracted(spark, d)).select("doc", "status", F.length("prompt").cast("long").alias("prompt"))


@query(_FILES + " select status, count(*) as files, coalesce(sum(case when status = 'done' then least(n, 3) end), 0) as entities from s group by status")
def i17_pipeline_summary(spark, d) -> DataFrame:
    """Files by status, and how many entities those that are done name."""
    files, found = extracted(spark, d)
    _, _, status = pl.files_to_graph(files, found)
    rows = status.join(found.select("doc", F.size("entities").alias("n")), "doc")
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(c("status") == "done", c("n"))), F.lit(0)).cast("long").alias("entities"))


@query(_PROSE.replace("LIMIT", "800").replace("select doc_id as file,", "select cast(doc_id as varchar) as file,"))
def r2_backfill_stream(spark, d) -> DataFrame:
    """Chunks of all documents by a stream that ends when all are done, run twice over."""
    root = f"{shared_folder(spark)}/backfill-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(c("doc_id").cast("string").alias("file"), "text").write.parquet(f"{root}/in")
    docs = lambda: spark.readStream.schema("file string, text string").parquet(f"{root}/in")
    pl.stream_backfill(docs(), f"{root}/chunks", f"{root}/mark")
    pl.stream_backfill(docs(), f"{root}/chunks", f"{root}/mark")
    return spark.read.parquet(f"{root}/chunks").select("file", "seq", "block", "text")


@query(
    g(_PROVEN + """, rd as (select 'R' || r_regionkey as reg_id, r_name as region, r_regionkey as k from region),
    e as (select label, min((a, ord)) as o from (select n.label, case e.src when 'FRF1' then 0 when 'FRO1' then 1 else 2 end as a, e.ord from e2 e join n2 n on n.id = e.dst and n.type = 'doc' where e.rel = 'EVIDENCED_BY' and e.src in ('FRF1', 'FRO1', 'C1')) group by label)
    select region, case when k % 2 = 0 then 'high' else 'low' end as level, (select label from n2 where id = reg_id) as reg, (select coalesce(list(id || ':' || label order by i), []) from (select unnest(['A_BUILDING', 'A_NONE', 'A_MACHINERY']) as x, unnest([0, 1, 2]) as i) a join n2 on n2.id = x where rd.k < 3) as actions,
      (select coalesce(list(label order by o), []) from e) as evidence from rd""")
)
def g21_region_details(spark, d) -> DataFrame:
    """Rule, actions and evidence for every region."""
    gr = proven_graph(spark, d)
    k = c("r_regionkey")
    acts = F.when(k < 3, F.array(F.lit("A_BUILDING"), F.lit("A_NONE"), F.lit("A_MACHINERY"))).otherwise(F.array().cast("array<string>"))
    regions = table(spark, d, "region").select(F.lit("main").alias("canvas_id"), c("r_name").alias("region"), F.when(k % 2 == 0, "high").otherwise("low").alias("level"), F.concat(F.lit("R"), k).alias("reg_id"), acts.alias("action_ids"))
    found = pl.region_details(regions, gr.nodes, gr.edges, ["FRF1", "FRO1", "C1"])
    return found.select("region", "level", "reg", F.transform("actions", lambda a: F.concat_ws(":", a["id"], a["label"])).alias("actions"), "evidence")
