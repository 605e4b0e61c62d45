"""Repeated passages by sparse suffix arrays.

A passage is ``LEAST`` words that stand in two different texts, or in two rows with equal texts.  Of all word
suffixes only those are retained that start at a minimiser: the leftmost least hash of ``WINDOW`` neighbouring
``GRAM``-word grams.  The choice depends on nothing but the words there, so equal passages retain equal suffixes.
Every stretch of LEAST words has its first minimiser within its first WINDOW words, and the suffix from
there shares at least ``HEAD`` words with its equal elsewhere.

1. The suffixes are sorted by their first HEAD words (as one hash), then by the codes of the words that follow: a
   distributed suffix array, ranges of which are the partitions.  Suffixes with equal heads are neighbours; ranges are
   cut by head and text, so a head that stands in a third of all texts is spread over many partitions.
2. In each run of equal heads, matches are extended to the left and to the right, word code by word code, up to the
   stretches of LEAST words whose first minimiser is this suffix (longer matches have further minimisers and are put together
   from these).  For each number of words to the left, the suffixes are sorted by those words and the words to the right;
   neighbours of different texts share the stretch.
3. A run that goes on in another part of the order (a part has about ``CHUNK`` suffixes) hands on its stretches that met no
   other text there, and one row with the least and the greatest text for each stretch; a join over all parts settles them.
4. Stretches found in two texts are merged into the longest repeated spans of each text.

Word codes have 32 bits, heads and texts 64; two stretches that differ are taken for equal only if such hashes collide.

Defined results: null texts, empty texts and texts shorter than LEAST words have no spans; very long texts are read
whole; of rows with equal texts, all are repeated as wholes; repeats inside one text alone are not counted; ties in the
order are between equal suffixes, all of which are compared; an empty table gives no rows; rows without an id are rows
like any other; repeated rows are equal texts; extra columns, clashing names among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, settle, table
from .wordhash import Block, blocks, gram_hashes, mix, word_hashes, words

LEAST, GRAM, WINDOW = 50, 5, 32
HEAD = LEAST - WINDOW + 1
SIDE = LEAST - HEAD
CHUNK = 1 << 16
#: Words of the texts whose suffixes make one range of the order (about 25 MB), and the most ranges.
PART_WORDS, MOST_PARTS = 4_000_000, 50_000
_STEP, _SIDES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def minimisers(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, bounds of the rows, starts of all stretches of LEAST words inside a row, and the first minimiser of each."""
    found = words(block)
    hashes = word_hashes(block, found)
    per_row = np.maximum(np.diff(found.bounds) - LEAST + 1, 0)
    before = np.cumsum(per_row) - per_row
    start = np.arange(per_row.sum()) + np.repeat(found.bounds[:-1] - before, per_row)
    if not len(start):
        return hashes, found.bounds, start, start
    grams = gram_hashes(hashes, GRAM)
    least, width = np.arange(len(grams)), 1
    while width < WINDOW:  # place of the leftmost least gram among the next 2, 4, ... grams
        left, right = least[: len(least) - width], least[width:]
        least, width = np.where(grams[right] < grams[left], right, left), 2 * width
    return hashes, found.bounds, start, least[start]


def run_hashes(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words from each start."""
    out = np.full(len(start), n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[start + i]
    return mix(out)


def _codes(code: np.ndarray, first: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    """For each suffix the codes of ``count`` words from ``first`` on, to the right (step 1) or to the left (step -1), as binary."""
    bounds = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    values = code[np.repeat(first, count) + step * within].astype(">u4")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(values)])


def retained(texts: DataFrame) -> DataFrame:
    """``head, right, left, text_id, place``: the retained suffixes of ``texts`` (text_id, text), one row each.

    head: hash of the first HEAD words.  right, left: codes of the words after the head and before the suffix (nearest
    first), as far as stretches with this first minimiser reach.  place: word position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                hashes, bounds, start, chosen = minimisers(block)
                if not len(start):
                    continue
                first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                last = np.append(first[1:], len(chosen)) - 1
                place = chosen[first]
                row = np.searchsorted(bounds, place, "right") - 1
                code = (hashes >> np.uint64(32)).astype(np.uint32)
                columns = [
                    pa.array(run_hashes(hashes, place, HEAD).view(np.int64)),
                    _codes(code, place + HEAD, SIDE - (place - start[last]), 1),
                    _codes(code, place - 1, place - start[first], -1),
                    batch["text_id"].slice(block.first, block.rows).take(pa.array(row)),
                    pa.array((place - bounds[row]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "right", "left", "text_id", "place"])

    return texts.mapInArrow(run, "head long, right binary, left binary, text_id long, place int")


def _prefix_hashes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0, 1, ... SIDE codes of each row (columns beyond its length are void) and its number of codes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[array.offset : array.offset + len(array) + 1] // 4
    count = np.diff(offsets)
    codes = np.frombuffer(values, dtype=">u4") if values is not None and values.size else np.zeros(0, ">u4")
    codes = codes[offsets[0] : offsets[-1]].astype(np.uint64)
    matrix = np.zeros((len(array), SIDE), dtype=np.uint64)
    matrix[np.repeat(np.arange(len(array)), count), np.arange(len(codes)) - np.repeat(offsets[:-1] - offsets[0], count)] = codes
    out = np.empty((len(array), SIDE + 1), dtype=np.uint64)
    out[:, 0] = 1
    for i in range(SIDE):
        out[:, i + 1] = mix(out[:, i] * _STEP + matrix[:, i])
    return out, count


def _extend(rows: pa.Table, open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
    """Stretches of sorted suffixes that stand in two texts, and what is left open in the first and the last run.

    Rows (text_id, place, mask): bit o of the mask is set where the stretch from o words left of the suffix is shared.  With a
    key, such a row waits for another text with the same key; rows (key, low, high) tell the texts of a key.
    """
    head, text, place = (rows[n].to_numpy() for n in ("head", "text_id", "place"))
    again = (head[1:] == head[:-1]) & (text[1:] == text[:-1]) & (place[1:] == place[:-1])
    if again.any():  # neighbours from rows with equal texts
        rows = rows.filter(pa.array(np.concatenate(([True], ~again)))).combine_chunks()
        head, text, place = (rows[n].to_numpy() for n in ("head", "text_id", "place"))
    left, most = _prefix_hashes(rows["left"])
    right, reach = _prefix_hashes(rows["right"])
    least = SIDE - reach
    count = most - least + 1
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(head)), count)
    o = np.arange(len(row)) - first[row] + least[row]
    key = mix(mix(left[row, o] + o.astype(np.uint64) * _SIDES) * _STEP + right[row, SIDE - o] + head.view(np.uint64)[row])
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    texts = text[row[order]]
    low, high = np.minimum.reduceat(texts, starts), np.maximum.reduceat(texts, starts)
    shared = np.empty(len(row), dtype=bool)
    shared[order] = (low != high)[group]
    bit = np.int64(1) << o.astype(np.int64)
    mask = np.bitwise_or.reduceat(np.where(shared, bit, 0), first)
    some = np.flatnonzero(mask)
    yield _found(text_id=text[some], place=place[some], mask=mask[some])
    waits = ((head == head[0]) if open_first else False) | ((head == head[-1]) if open_last else np.zeros(len(head), bool))
    pairs = np.flatnonzero(waits[row] & ~shared)
    yield _found(text_id=text[row[pairs]], place=place[row[pairs]], mask=bit[pairs], key=key[pairs].view(np.int64))
    groups = np.flatnonzero(waits[row[order[starts]]])
    yield _found(key=key[order[starts[groups]]].view(np.int64), low=low[groups], high=high[groups])


_FOUND = {"text_id": pa.int64(), "place": pa.int32(), "mask": pa.int64(), "key": pa.int64(), "low": pa.int64(), "high": pa.int64()}


def _found(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in _FOUND.items()], names=list(_FOUND))


def _compared(suffixes: DataFrame, parts: int) -> DataFrame:
    """What ``_extend`` finds in the sorted suffixes, in ``parts`` ranges: whole runs, and pieces of runs longer than a chunk or over a border."""
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, going_on = None, True
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows < size:
                continue
            head = rest["head"].to_numpy()
            other = np.flatnonzero(head != head[-1])
            cut = int(other[-1]) + 1 if len(other) else len(head)
            yield from _extend(rest.slice(0, cut).combine_chunks(), going_on, not len(other))
            rest, going_on = rest.slice(cut) if cut < len(head) else None, not len(other)
        if rest is not None and rest.num_rows:
            yield from _extend(rest.combine_chunks(), going_on, True)

    schema = "text_id long, place int, mask long, key long, low long, high long"
    return suffixes.repartitionByRange(parts, "head", "text_id").sortWithinPartitions("head", "right", "text_id", "place").mapInArrow(run, schema)


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of each text as spans (start, end) in words, from its pairs of place and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch["found"]:
                place, mask = (value.values.field(i).to_numpy() for i in (0, 1))
                at = np.unique(np.concatenate([place[mask >> o & 1 == 1] - o for o in range(SIDE + 1)]))
                first = np.concatenate(([True], np.diff(at) > LEAST))
                last = np.concatenate((first[1:], [True]))
                spans.append([{"start": int(a), "end": int(b) + LEAST} for a, b in zip(at[first], at[last])])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["text_id"], pa.array(spans, kind)], names=["text_id", "spans"])

    lists = found.groupBy("text_id").agg(F.collect_list(F.struct("place", "mask")).alias("found"))
    return lists.mapInArrow(run, "text_id long, spans array<struct<start: bigint, end: bigint>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, copy_of, n_words, n_repeated, spans``; spans are word ranges, end exclusive.

    copy_of: least id of the rows with an equal text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_id"), text.alias("text"))
    light = settle(rows.select("doc_id", "text_id", n_words(F.col("text")).alias("n_words")))
    texts = settle(light.groupBy("text_id").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")))
    n_rows, all_words = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("n_words")), F.lit(0))).first()
    # texts with more than a thousandth of all rows: fewer than a thousand, so these can be sent to all tasks
    hot = texts.where(F.col("copies") > max(n_rows // 1000, 1))
    # texts that can have a stretch at all; of those with very many rows one row, of the others all (equal suffixes are neighbours)
    long = rows.where(F.octet_length("text") >= 2 * LEAST - 1).select("text_id", "text")
    ids = F.broadcast(hot.select("text_id"))
    different = long.join(ids, "text_id", "left_anti").unionByName(long.join(ids, "text_id").groupBy("text_id").agg(F.first("text").alias("text")))
    found = settle(_compared(retained(different), min(max(all_words // PART_WORDS, 1), MOST_PARTS)))
    shared = found.where("low is not null").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key")
    waiting = found.where("key is not null and mask is not null").join(shared, "key", "left_semi")
    spans = _merged(found.where("key is null").unionByName(waiting.select(*found.columns)).select("text_id", "place", "mask"))
    whole = F.when((F.col("copies") > 1) & (F.col("n_words") >= LEAST), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    told = ("doc_id", "copy_of", "n_words", "copies")
    rows = light.drop("n_words")
    often = rows.join(F.broadcast(hot), "text_id").select(*told, none.alias("found"))
    others = rows.join(ids, "text_id", "left_anti").join(texts.join(spans, "text_id", "left"), "text_id")
    out = often.unionByName(others.select(*told, F.col("spans").alias("found"))).withColumn("spans", F.coalesce(whole, "found", none))
    repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "copy_of", "n_words", repeated.alias("n_repeated"), "spans")


def op9_sparse_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("n_spans", F.size("spans").cast("long")).withColumn("spans", listed)
