"""Incremental merges as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.graph import first_per_key
from kgspark.operators.merge import NODE


class NodeTable:
    """Nodes kept as Parquet in folders by key bucket and micro-batch.

    A batch reads the buckets of its own keys only and writes no others; a replayed batch finds the rows of earlier ones alone and replaces
    just its own folders, so it changes nothing.  There must be one writer at a time.
    """

    def __init__(self, spark, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema + ", bucket int, batch_id long").parquet(self.path).drop("bucket")

    def merge(self) -> Callable[[DataFrame, int], None]:
        """Sink for ``foreachBatch``: adds the nodes whose key no earlier batch has, the first of each key."""

        def run(batch: DataFrame, batch_id: int) -> None:
            new = first_per_key(batch, NODE, "ord").withColumn("bucket", F.pmod(F.xxhash64(*NODE), F.lit(self.buckets)).cast("int"))
            if batch_id > 0:
                touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most one number for each bucket
                every = self.spark.read.schema(self.schema + ", bucket int, batch_id long").parquet(self.path)
                known = every.where(F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id)).select("bucket", *NODE)
                new = new.join(known, ["bucket", *NODE], "left_anti")
            new = new.withColumn("batch_id", F.lit(batch_id).cast("long"))
            new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(self.path)

        return run


def first_wins(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One row of each key, the first that comes; keys are forgotten ``delay`` after the watermark, rows later than it are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def operation_counts(log: DataFrame, time: str = "at", width: str = "1 hour") -> DataFrame:
    """Entries of a change log by operation and time window; entries without a time are one window of their own, which has no start."""
    undated = F.col(time).isNull()
    filled = F.coalesce(time, F.lit("1970-01-01").cast(log.schema[time].dataType))  # ``window`` drops rows without a time
    found = log.groupBy(F.window(filled, width), undated.alias("undated"), "op").agg(F.count("*").alias("entries"))
    return found.select(F.when(~F.col("undated"), F.col("window.start")).alias("start"), "op", "entries")


class LogCounts:
    """``operation_counts`` of a stream, kept as Parquet in one folder for each micro-batch.

    A batch adds the counts of its own entries, which are summed when read.  So every entry counts, however late it comes and though its
    window is not over; no state is held between batches, and a replayed batch replaces just its own folder.
    """

    def __init__(self, spark, path: str, time_type: str = "timestamp", width: str = "1 hour"):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width
        self.schema = f"start {time_type}, op string, entries long, batch_id long"

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).groupBy("start", "op").agg(F.sum("entries").alias("entries"))

    def add(self) -> Callable[[DataFrame, int], None]:
        """Sink for ``foreachBatch``: adds the counts of a batch of rows (at, op)."""
        return lambda batch, batch_id: operation_counts(batch, width=self.width).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
