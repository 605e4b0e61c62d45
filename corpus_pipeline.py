"""A training-corpus pipeline out of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs; all but the last return the columns of ``documents``.

1. quality_rules: rows that the quality rules reject go.
2. ngram_jaccard: of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row stays.
3. decontaminate: rows that hold a benchmark item go.
4. mix: rows are taken as often as the mix of sources says, nearest to a whole number of times; rows without words stay once.
5. shard: every row gets its shard and its slot.

Defined results: a null, empty or very short text fails the quality rules, a very long one is judged and kept whole; a null id,
language or source is a value like any other; of ties (equal texts, equal least ids) one row stays, whichever, as they are
alike; repeated rows are near duplicates of each other; an empty table gives no rows; extra columns, with names that the
stages use themselves too, pass through all stages but the last, which has columns of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from kgspark.llm.common import table, text_key
from kgspark.operators.lineage import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)
    copies = taken.groupBy("doc_id", "source", "text_key").agg(F.sum(times).cast("int").alias("copies"), F.count("*").alias("rows"))
    copies = copies.select(F.struct("doc_id", "source", "text_key").alias("id"), "copies", "rows")
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", "source", text_key(F.col("text")).alias("text_key")).alias("own"))
    single, several = copies.where("rows = 1"), copies.where("rows > 1")
    one = rows.join(single, rows["own"].eqNullSafe(single["id"])).select("row", "copies")
    # rows equal in id, source and text are one row that is taken as often as all of them together
    more = rows.join(several, rows["own"].eqNullSafe(several["id"])).groupBy("own").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    taken = one.unionByName(more.select("row", "copies"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

# SQL can express neither the trees, nor the forest join, nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows stand in Parquet in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
