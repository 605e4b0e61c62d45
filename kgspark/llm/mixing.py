"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) get weights 5, 2, 1, repeating, and share ``budget`` times all words;
a target stops at twice its source's size and the excess is shared anew by weight.  Rows are dealt to shards
by a seeded hash.  In each shard the sources compete for blocks of equally many words: the next block goes
to the source with the highest quotient weight / (2 * blocks + 1), where the weight is the source's part of
its target in this shard, up to two passes over its rows.  The rows of a source in a shard stand in seeded
order on a line of words; whole passes of a quota take all of them once, the rest of the quota is a run of
blocks from a seeded start.

Defined results: null and empty texts have size 0 and take 0 words; a very long text is one row of its shard, which is
larger for it; an empty table gives no rows; repeated rows are rows of their own; rows without an id are dealt like any
other.  Only the columns named here are read, so extra columns, clashing names among them, do not matter.  Ties in the seeded
order are between equal rows only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, settle, table, text_key

WEIGHTS = (5, 2, 1)


def capped_targets(sizes: Sequence[int], weights: Sequence[float], budget: float, repeats: float = 2.0) -> np.ndarray:
    """Shares of ``budget`` by weight, none above ``repeats`` times its size; what is above goes to the others by weight."""
    sizes, weights = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    caps, target, open_ = repeats * sizes, np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    while open_.any():
        share = (budget - caps[~open_].sum()) * weights / weights[open_].sum()
        above = open_ & (share > caps)
        if not above.any():
            target[open_] = share[open_]
            break
        open_ &= ~above
    target[~open_] = caps[~open_]
    return target


def sainte_lague(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotient weight / (2 * seats + 1), at most ``caps`` each; ties go to the first."""
    weights, caps = np.asarray(weights, dtype=float), np.where(np.asarray(weights) > 0, caps, 0).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def held(threshold: float) -> np.ndarray:
        return np.minimum(caps, np.floor((weights / threshold + 1) / 2)).astype(np.int64)

    low, high = weights[weights > 0].min() / (2.0 * caps.max() + 3), weights.max() * 2
    for _ in range(100):  # the smallest threshold that gives out no more than the seats
        middle = (low + high) / 2
        low, high = (low, middle) if held(middle).sum() <= seats else (middle, high)
    out = held(high)
    while (left := seats - out.sum()) > 0:
        quotient = np.where(out < caps, weights / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[: min(left, (quotient > 0).sum())]] += 1
    return out


def _quotas(batches: Iterator[pa.RecordBatch], block: int, repeats: int) -> Iterator[pa.RecordBatch]:
    """``shard, rank, words, quota`` from the list of the sources of each shard."""
    for batch in batches:
        cells = batch["cells"]
        bounds, rank, words, size, target = cells.offsets.to_numpy(), *(cells.values.field(i).to_numpy() for i in range(4))
        weight = target * words / np.maximum(size, 1)
        quota = np.zeros(len(rank), dtype=np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            seats = sainte_lague(weight[a:b], np.ceil(repeats * words[a:b] / block), int(weight[a:b].sum() / block + 0.5))
            quota[a:b] = np.minimum(seats * block, repeats * words[a:b])
        shard = np.repeat(batch["shard"].to_numpy(), np.diff(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(rank), pa.array(words), pa.array(quota)], names=["shard", "rank", "words", "quota"])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = 1.5,
    repeats: int = 2,
    seed: int = 7,
    shard_words: int = 100_000,
    max_block: int = 1024,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """Every row of ``docs`` with ``doc_id, source, text_key, size, source_size, target, taken``.

    The table of sources goes to the driver; more than ``max_sources`` of them are an error, never a cut.
    """
    spark = docs.sparkSession
    rows = settle(docs.select("doc_id", "source", text_key(F.col("text")).alias("text_key"), n_words(F.col("text")).alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in sources]
    total = sum(sizes)
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], budget * total, repeats)
    shards = max(1, -(-total // shard_words))
    block = int(min(max_block, max(1, min((t for t in target if t > 0), default=1) // (64 * shards))))
    plan = spark.createDataFrame(
        [(i, r[0], int(r[1]), float(t)) for i, (r, t) in enumerate(zip(sources, target))], "rank int, source string, source_size long, target double"
    )
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(shards)))
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    cells = rows.groupBy("shard", "rank").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    lists = cells.repartition(max(1, shards // 64), "shard").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rank", "words", "source_size", "target"))).alias("cells"))
    quota = lists.mapInArrow(lambda batches: _quotas(batches, block, repeats), "shard long, rank int, words long, quota long")
    order = Window.partitionBy("shard", "rank").orderBy("turn", "doc_id", "text_key")
    line = rows.withColumn("turn", F.xxhash64(F.lit(seed + 1), "text_key", "doc_id")).withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("from", F.col("to") - F.col("size")).join(quota, ["shard", "rank"])
    rest = F.col("quota") % F.col("words")
    start = F.pmod(F.xxhash64("shard", "rank", F.lit(seed + 2)), F.greatest(F.ceil(F.col("words") / block), F.lit(1))) * block

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least(F.col("to"), high) - F.greatest(F.col("from"), low))

    extra = overlap(F.col("start"), F.col("start") + F.col("rest")) + overlap(F.lit(0), F.col("start") + F.col("rest") - F.col("words"))
    taken = F.when(F.col("words") > 0, F.col("size") * F.floor(F.col("quota") / F.col("words")) + extra).otherwise(0)
    line = line.withColumn("rest", F.when(F.col("words") > 0, rest).otherwise(0)).withColumn("start", start).withColumn("taken", taken.cast("long"))
    return line.select("doc_id", "source", "text_key", "size", "source_size", "target", "taken")


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
