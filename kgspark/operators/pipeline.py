"""Files into the graph with a reason for each that is passed over, and backfills of what is still without chunks or vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import backfill
from .ingest import extraction_to_graph

#: Fixed value: characters of a text that an extraction is given.
TEXT_CAP = 12_000


def passed_over(files: DataFrame, extractions: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """``doc, status, prompt`` of files (doc, text, error): what goes to the extraction, and why a file brings nothing.

    extractions: (doc, entities, failed) of the files that were extracted.  failed: the reader or the extraction did; no text: blank;
    no entity: nothing was found; done: the rest.  Only texts that are extracted have a prompt.
    """
    found = extractions.select("doc", F.size("entities").alias("_n"), F.coalesce("failed", F.lit(False)).alias("_failed"))
    rows = files.join(found, "doc", "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    status = F.when(F.col("error").isNotNull(), "failed").when(blank, "no text").when(F.col("_failed") | F.col("_n").isNull(), "failed").when(F.col("_n") <= 0, "no entity").otherwise("done")
    return rows.select("doc", status.alias("status"), F.when(F.col("error").isNull() & ~blank, F.substring("text", 1, cap)).alias("prompt"))


def files_to_graph(files: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the files that are done, and the status of all; extractions: (doc, entities, relations, failed)."""
    status = passed_over(files, extractions)
    good = extractions.join(status.where("status = 'done'").select("doc"), "doc", "left_semi").select("doc", "entities", "relations")
    return *extraction_to_graph(good), status.select("doc", "status")


def stream_backfill(docs: DataFrame, path: str, mark: str, write: Callable[[DataFrame, int], None] | None = None, most: int = 800) -> None:
    """Chunks for all documents (file, text) of a stream that have none in ``path`` yet; runs over what is there and ends.

    Batches go one at a time; each looks at the chunks of earlier ones again, so documents that come twice, and batches that
    are repeated after a failure, add nothing.  ``mark`` is the checkpoint folder of the stream.
    """
    spark = docs.sparkSession
    schema = "file string, seq int, block string, text string"

    def run(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(schema + ", batch long").parquet(path).where(F.col("batch") < number) if number else spark.createDataFrame([], schema)
        new = backfill(batch.dropDuplicates(["file"]), earlier.select("file").distinct(), most=most)
        (write or (lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")))(new, number)

    docs.writeStream.foreachBatch(run).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def region_details(regions: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: list[str]) -> DataFrame:
    """``region, level, reg, props, actions, evidence``: what is known of regions (canvas_id, region, level, reg_id, action_ids).

    reg: label of the region's rule; actions: (id, label) of those that the graph has, in the order given; evidence: distinct file names
    behind the anchors, in order.  Anchors are a handful of node ids.
    """
    label = nodes.select("canvas_id", "id", "label", "props")
    rules = label.select("canvas_id", F.col("id").alias("reg_id"), F.col("label").alias("reg"), "props")
    each = regions.select("canvas_id", "region", F.posexplode("action_ids").alias("i", "id")).join(label.drop("props"), ["canvas_id", "id"])
    actions = each.groupBy("canvas_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id", "label"))), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).alias("actions"))
    docs = nodes.where("type = 'doc'").select("canvas_id", F.col("id").alias("dst"), F.col("label").alias("filename"))
    proof = edges.where((F.col("rel") == "EVIDENCED_BY") & F.col("src").isin(*anchors)).join(docs, ["canvas_id", "dst"])
    rank = F.coalesce(*(F.when(F.col("src") == a, i) for i, a in enumerate(anchors)))
    first = proof.groupBy("canvas_id", "filename").agg(F.min(F.struct(rank.alias("a"), "ord")).alias("o"))
    files = first.groupBy("canvas_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "filename"))), lambda x: x["filename"]).alias("evidence"))
    rows = regions.join(rules, ["canvas_id", "reg_id"], "left").join(actions, ["canvas_id", "region"], "left").join(files, "canvas_id", "left")
    none = lambda kind: F.array().cast(kind)
    return rows.select("region", "level", "reg", "props", F.coalesce("actions", none("array<struct<id:string,label:string>>")).alias("actions"), F.coalesce("evidence", none("array<string>")).alias("evidence"))
