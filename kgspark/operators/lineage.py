"""Lineage cuts for iterative operators, and the folder that a session's tasks share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session that runs in one process gets a new local folder; on a cluster that is an error, as no machine
    can read another one's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def in_blocks(queries: DataFrame, key: str, size: int = 1000) -> Iterator[DataFrame]:
    """A query set in parts of about ``size`` rows, each of which may be sent to all tasks; without rows one empty part."""
    queries = settle(queries)
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        yield F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == b))
