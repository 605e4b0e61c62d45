"""Substring search over fields of objects by postings of three-character grams.

A posting says at which places of a field's text a gram begins; ends of texts are padded, so every place has one.  Postings
stand in Parquet, in folders by first character and sorted by gram.  A term is found where its grams follow each other at the right
distance, so a search reads the folders of its terms' first characters and never the objects.  A refresh adds a segment with the postings
of the changed objects, and a note that their older ones are void; one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import settle, shared_folder

GRAM = 3
BUCKETS = 64
PAD = "\0" * (GRAM - 1)
POSTING = "gram string, id string, field string, part int, places array<int>, segment int, bucket int"


def _bucket(gram: str):
    return F.pmod(F.crc32(F.substring(gram, 1, 1).cast("binary")), F.lit(BUCKETS)).cast("int")


def _postings(fields: DataFrame) -> DataFrame:
    """``gram, id, field, part, places``: one row for each different gram of a text."""
    rows = fields.where(F.length("t") > 0).select("id", "field", F.col("part").cast("int").alias("part"), F.length("t").alias("n"), F.concat("t", F.lit(PAD)).alias("t"))
    each = rows.select("id", "field", "part", "t", F.explode(F.sequence(F.lit(1), "n")).alias("place"))
    each = each.select("id", "field", "part", F.expr(f"substring(t, place, {GRAM})").alias("gram"), "place")
    return each.groupBy("gram", "id", "field", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))


@dataclass
class GramIndex:
    spark: SparkSession
    folder: str
    segments: int = field(default=0)

    def add(self, fields: DataFrame) -> None:
        """Writes the postings of fields (id, field, part, t) as the next segment; earlier postings of their objects are void from then on."""
        self.refresh(fields, fields.select("id").distinct())

    def refresh(self, fields: DataFrame, changed: DataFrame) -> None:
        """As above for the changed objects (id), some of which may have no fields any more."""
        at = self.segments
        rows = _postings(fields).withColumn("segment", F.lit(at)).withColumn("bucket", _bucket("gram"))
        rows.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.folder}/postings")
        if at:  # the first segment has nothing before it
            changed.select("id", F.lit(at).alias("since")).write.mode("append").parquet(f"{self.folder}/void")
        self.segments += 1

    def find(self, terms: DataFrame) -> DataFrame:
        """``term, id, field, part``: where each term (term) stands; empty terms stand nowhere."""
        asked = settle(terms.where(F.length("term") > 0).select("term").distinct())
        buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]  # BUCKETS at most; every piece of a longer term adds its own
        long = asked.where(F.length("term") >= GRAM)
        last = F.length("term") - GRAM
        offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
        pieces = settle(long.select("term", F.size(offsets).alias("needed"), F.explode(offsets).alias("offset")).withColumn("gram", F.expr(f"substring(term, offset + 1, {GRAM})")))
        buckets = sorted({*buckets, *(r[0] for r in pieces.select(_bucket("gram")).distinct().collect())})
        rows = self.spark.read.schema(POSTING).parquet(f"{self.folder}/postings").where(F.col("bucket").isin(buckets))
        if self.segments > 1:
            void = self.spark.read.parquet(f"{self.folder}/void").groupBy("id").agg(F.max("since").alias("since"))
            rows = rows.join(void.withColumnRenamed("id", "own"), (F.col("id") == F.col("own")) & (F.col("segment") < F.col("since")), "left_anti")
        met = rows.join(pieces, "gram").select("term", "needed", "id", "field", "part", F.explode("places").alias("place"), "offset")
        met = met.groupBy("term", "needed", "id", "field", "part", (F.col("place") - F.col("offset")).alias("start")).agg(F.count("*").alias("n")).where("n = needed")
        short = asked.where(F.length("term") < GRAM)
        heads = rows.select("id", "field", "part", F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.substring(F.col("gram"), F.lit(1), n))).alias("term"))
        return met.select("term", "id", "field", "part").unionByName(heads.join(short, "term").select("term", "id", "field", "part")).distinct()


def build(fields: DataFrame) -> GramIndex:
    """Index of fields (id, field, part, t) in a new folder of the shared one."""
    spark = fields.sparkSession
    index = GramIndex(spark, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}")
    index.add(fields)
    return index
