"""Sharding by vector bin packing.

Rows with equal texts form a group; a group stays together unless it alone exceeds a shard's share of the bytes, tokens
or rows.  Only such a group is cut, by a hash of its rows.  Every group is a vector (bytes, tokens, rows), each divided
by its total.  Groups with more than ``1 / (shards * split)`` of any total are packed one by one; at most
``3 * shards * split`` are that large.  The many small ones are first bundled with others of like vectors: a class of
equal powers of two in bytes, bytes per token and rows is hashed into as many bundles as its share of the totals asks for,
so what the driver packs is a table of bounded size however many rows there are.

Items are taken largest first and go to the shard where the dot product of the item and the shard's residual capacity is
highest among those that have room for its bytes.  After that, single items move or swap between the fullest and the
emptiest shard while this lowers the gap of bytes, preferring what leaves tokens and rows even.

Law ``bytes``: shard sizes differ by about one bundle of the smallest kind at most.

Defined results: a null text has 8 bytes and the crc32 of the empty text, with which it forms a group; a very long text is one row and never cut;
an empty table gives no rows; repeated rows are rows of their own; rows without an id are dealt like any other; extra columns,
clashing names among them, are not read; ties in the slot order are between rows equal in id and text only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, settle, table, text_key

SHARDS = 24


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``items`` has one row of non-negative measures per item, the first one leading."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    return _even_out(share, fill(share, shards), shards)


def fill(share: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, largest first, by the highest dot product with residual capacity among those with room."""
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.zeros(len(share), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        room = residual[:, 0] >= share[i, 0]
        fit = residual @ share[i]
        choice = np.argmax(np.where(room, fit, -np.inf)) if room.any() else np.argmax(residual[:, 0])
        out[i] = choice
        residual[choice] -= share[i]
    return out


def _even_out(share: np.ndarray, out: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Moves one item, or swaps two, between the shard with most and the one with fewest bytes while that gap closes.

    Of the changes that close at least half of what the best one closes, the one that leaves the other measures most even is made.
    """
    load = np.zeros((shards, share.shape[1]))
    np.add.at(load, out, share)
    least = 1e-12
    for _ in range(rounds):
        high, low = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[high] - load[low]
        mine, theirs = np.flatnonzero(out == high), np.flatnonzero(out == low)
        theirs = theirs[np.argsort(share[theirs, 0], kind="stable")]
        given = np.concatenate((np.zeros((1, share.shape[1])), share[theirs]))
        at = np.clip(np.searchsorted(given[:, 0], share[mine, 0] - gap[0] / 2), 1, len(given) - 1) if len(theirs) else np.zeros(len(mine), int)
        item = np.concatenate((mine, mine, mine))
        back = np.concatenate((np.zeros(len(mine), int), at, np.maximum(at - 1, 0)))
        after = np.abs(gap - 2 * (share[item] - given[back]))
        closed = np.where(share[item, 0] > given[back, 0], gap[0] - after[:, 0], -1.0)
        if not len(closed) or closed.max() <= least:
            break
        good = np.flatnonzero(closed >= closed.max() / 2)
        k = good[int((after[good, 1:].sum(axis=1)).argmin())]
        net = share[item[k]] - given[back[k]]
        out[item[k]] = low
        if back[k]:
            out[theirs[back[k] - 1]] = high
        load[high] -= net
        load[low] += net
    return out


def shard(docs: DataFrame, shards: int = SHARDS, bundles: int = 4096, split: int = 32, cell_rows: int = 2000) -> DataFrame:
    """Columns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens`` of every row of ``docs``.

    bundles: number of bundles of small groups, a few more by rounding.  split: a group of more than 1 / (shards * split) of
    all bytes, tokens or rows is packed by itself.  cell_rows: rows that one task numbers at a time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            n_words(F.col("text")).alias("tokens"),
            text_key(text).alias("key"),
        )
    )
    rows = rows.withColumn("like", F.struct(F.floor(F.log2("size")).alias("bytes"), F.floor(F.log2(F.col("size") / (F.col("tokens") + 1))).alias("bytes_per_word")))
    spread = F.xxhash64("doc_id", "text_crc32", F.lit("row"))
    sums = F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count("*").alias("rows")
    totals = rows.agg(*sums).first()
    largest = F.greatest(*(F.col(c) / F.lit(float(totals[c] or 1)) for c in ("bytes", "words", "rows")))
    pieces = F.when((largest > 1.0 / shards) & (F.col("rows") > 1), F.ceil(largest * shards * split)).otherwise(1)
    # at most 3 * shards * split groups are packed by themselves
    large = rows.groupBy("key").agg(*sums).where(largest > 1.0 / (shards * split)).select("key", pieces.alias("pieces"))
    # one row for each class of like vectors: some hundred pairs of powers of two
    wide = rows.groupBy("like").agg(*sums).select("like", F.ceil(largest * bundles).alias("wide"))
    unit = F.when(F.col("pieces").isNotNull(), F.concat_ws(":", F.hex("key"), F.pmod(spread, F.col("pieces")).cast("string"))).otherwise(
        F.concat_ws("/", F.col("like.bytes").cast("string"), F.col("like.bytes_per_word").cast("string"), F.pmod(F.xxhash64("key"), F.col("wide")).cast("string"))
    )
    rows = rows.join(F.broadcast(large), "key", "left").join(F.broadcast(wide), "like").withColumn("unit", unit).drop("key", "pieces", "like", "wide")
    # one row for each bundle, large group or piece
    items = sorted(rows.groupBy("unit").agg(*sums).collect())
    chosen = pack(np.array([r[1:] for r in items], dtype=float).reshape(-1, 3), shards)
    placed = docs.sparkSession.createDataFrame([(r[0], int(s)) for r, s in zip(items, chosen)], "unit string, shard int")
    rows = rows.join(F.broadcast(placed), "unit").drop("unit")
    cells = max(1, -(-totals["rows"] // (shards * cell_rows)))
    return _with_slots(rows, cells, spread).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def _with_slots(rows: DataFrame, cells: int, spread: Column) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps: cells of a shard are numbered apart and shifted by the rows before them."""
    rows = rows.withColumn("cell", F.pmod(spread, F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("i", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "cell"]).withColumn("slot", (F.col("start") + F.col("i")).cast("long"))


def op4_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
