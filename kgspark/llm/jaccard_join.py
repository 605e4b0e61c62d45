"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every class of equal texts has one signature of ``trees * DEPTH`` minimum hashes of its word 5-grams.  Each tree
is the table of one slice of the signatures in sorted order, a prefix trie.  Two texts are candidates if their slices share
a long enough prefix in some tree.  How long follows from the set sizes of all texts: starting from whole slices, the prefix is
shortened until the least similar pair from the threshold on that any of them can be part of meets in some tree with the
target probability (``measured_depth``).  Texts with so few grams that only an equal set is similar enough keep whole slices.

* In a run of at most ``SMALL`` texts with a common prefix the sorted rows are compared with their next neighbours.  A pair
  counts in the first tree where it meets, and goes on if the sizes allow the threshold.
* A longer run is cut into parts; each pair of parts is one task's work.  It verifies its candidates from the
  5-gram sets themselves and hands on only the number of links of each text and a spanning forest of them, so
  a group of near copies never becomes a table of all its pairs.

Links are exact: Jaccard similarity of the sets of 64-bit 5-gram hashes, at least ``threshold``.

Defined results: texts of one to four words have one gram, all their words; very long texts are read whole; null texts
and texts without a word are linked to nothing but equal texts; equal texts are always of one class; rows without an id
belong to the class of their text, whose id is the least non-null id; of tied ids the text decides, and rows equal in both
are alike; repeated rows are rows of their own; an empty table gives no rows; extra columns, clashing names among them, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.components import components

from .common import settle, table, text_key
from .wordhash import blocks, gram_hashes, mix, word_hashes, words

TREES, DEPTH, GRAM, SMALL, PART = 16, 6, 5, 16, 512
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


def least_similar(size: int, threshold: float) -> tuple[int, int]:
    """How many members to take from a set of ``size`` and how many new ones to add for the least similarity from the threshold on."""
    shared = np.arange(math.ceil(size * threshold - 1e-9), size + 1)
    union = np.floor(shared / threshold + 1e-9).astype(np.int64)  # the largest for each number of shared members
    best = np.argmin(shared / union)
    return size - int(shared[best]), int(union[best]) - size


def minima(grams: np.ndarray) -> np.ndarray:
    """The signature of one set of gram hashes."""
    return np.array([((grams * m) >> np.uint64(32)).min() for m in _MULTIPLIERS], dtype=np.uint32)


def shared_prefix(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the slices of two lists of signatures, for each tree."""
    same = (one == other).reshape(-1, TREES, DEPTH)
    return np.logical_and.accumulate(same, axis=2).sum(axis=2)


def measured_depth(sizes: DataFrame, threshold: float, target: float) -> int:
    """The longest prefix at which any pair at least as similar as the threshold meets in some tree with probability ``target`` (1 if none is short enough).

    sizes: ``key, grams`` of the texts.  Two sets have a minimum in common with a probability that is their similarity, so it is
    the least similarity that a text of each size can have that decides, over all texts; sizes of which only equal sets
    are similar enough are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [(size, *least_similar(size, threshold)) for size in batch["grams"].to_pylist()]
            found = [(size - taken) / (size + added) for size, taken, added in ways if taken or added]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], names=["similarity"])

    least = sizes.select("grams").distinct().mapInArrow(run, "similarity double").agg(F.min("similarity")).first()[0]
    depth = DEPTH
    while least is not None and depth > 1 and (1 - least**depth) ** TREES > 1 - target:
        depth -= 1
    return depth


def _grams(block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-grams of each row (of all words, if fewer) and the bounds of the rows."""
    found = words(block)
    hashes = word_hashes(block, found)
    count = np.diff(found.bounds)
    per_row = np.where(count >= GRAM, count - GRAM + 1, np.minimum(count, 1))
    to = np.concatenate(([0], np.cumsum(per_row)))
    start = np.arange(to[-1]) + np.repeat(found.bounds[:-1] - to[:-1], per_row)
    out = np.zeros(to[-1], dtype=np.uint64)
    long = np.repeat(count >= GRAM, per_row)
    if long.any():
        out[long] = gram_hashes(hashes, GRAM)[start[long]]
    for row in np.flatnonzero((count > 0) & (count < GRAM)):
        value = np.array([count[row]], dtype=np.uint64)
        for h in hashes[found.bounds[row] : found.bounds[row + 1]]:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h)
        out[to[row]] = value[0]
    return out, to


def _different(grams: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Number of different hashes of each row."""
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((grams, row))
    value, row = grams[order], row[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    return np.bincount(row[new], minlength=len(to) - 1).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, key, signature`` (binary, one 32-bit minimum per hash; null without words) and ``grams``, the number of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                grams, to = _grams(block)
                some = np.diff(to) > 0
                out = np.zeros((block.rows, len(_MULTIPLIERS)), dtype=np.uint32)
                if some.any():
                    for i, m in enumerate(_MULTIPLIERS):
                        out[some, i] = np.minimum.reduceat((grams * m) >> np.uint64(32), to[:-1][some])
                cut = slice(block.first, block.first + block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][cut],
                        batch["key"][cut],
                        pa.array([r.tobytes() if s else None for r, s in zip(out, some)], pa.binary()),
                        pa.array(_different(grams, to)),
                    ],
                    names=["doc_id", "key", "signature", "grams"],
                )

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, signature binary, grams long")


def _bands(signature: str, depth: str) -> Column:
    """For each tree a hash of the tree and the first ``depth`` minima of its slice of the signature."""
    return F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, {depth}, substring({signature}, t * {4 * DEPTH} + 1, 4 * {depth})))")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


def _first_meeting(one: np.ndarray, other: np.ndarray, tree: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether ``tree`` is the first where two signatures share a prefix of ``depth``."""
    met = shared_prefix(one, other) >= depth[:, None]
    return (met.argmax(axis=1) == tree) & met[np.arange(len(tree)), tree]


def _near_pairs(run: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of short runs: rows (band, tree, depth, key, grams, signature) in the order of the slices within each band.

    Pairs whose sizes exclude the threshold are left out; no other estimate keeps a pair from the exact check.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
            band, tree, depth, grams = (rows[n].to_numpy() for n in ("band", "tree", "depth", "grams"))
            key = rows["key"].to_pylist()
            signature = _matrix(rows["signature"], TREES * DEPTH)
            # rows seen before form pairs only with new ones
            seen = 0 if kept is None else kept.num_rows
            for step in range(1, SMALL):
                at = np.arange(max(0, seen - step), len(band) - step)
                at = at[band[at] == band[at + step]]
                at = at[np.minimum(grams[at], grams[at + step]) >= threshold * np.maximum(grams[at], grams[at + step])]
                if not len(at):
                    continue
                at = at[_first_meeting(signature[at], signature[at + step], tree[at], depth[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in at], pa.binary()), pa.array([key[i + step] for i in at], pa.binary())], names=["a", "b"])
            kept = rows.slice(max(0, len(band) - SMALL + 1))

    ordered = run.withColumn("slice", F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})"))
    return ordered.sortWithinPartitions("band", "slice", "key").drop("slice").mapInArrow(pairs, "a binary, b binary")


def gram_sets(docs: DataFrame) -> DataFrame:
    """``key, grams``: the sorted distinct 5-gram hashes of each row as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                grams, to = _grams(block)
                sets = [np.unique(grams[to[i] : to[i + 1]]).tobytes() for i in range(block.rows)]
                yield pa.RecordBatch.from_arrays([batch["key"].slice(block.first, block.rows), pa.array(sets, pa.binary())], names=["key", "grams"])

    return docs.mapInArrow(run, "key binary, grams binary")


def _set(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose gram sets are at least as similar as the threshold, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for one, other in zip(batch["ga"], batch["gb"]):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (one, other))
                if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                    value.append(0.0)
                    continue
                both = np.concatenate((a, b))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                value.append(shared / (len(both) - shared))
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(value)], names=["a", "b", "jaccard"])
            yield out.filter(pa.array(np.array(value) >= threshold))

    first = sets.select(F.col("key").alias("a"), F.col("grams").alias("ga"))
    second = sets.select(F.col("key").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a binary, b binary, jaccard double")


def _shared(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, by products of membership matrices."""
    sets = [*one, *other]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = count > 1
    column = np.cumsum(useful) - 1
    kept = useful[inverse]
    owner, column = owner[kept], column[inverse][kept]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(one), len(other)), dtype=np.float32)
    for start in range(0, int(useful.sum()), width):
        low, high = np.searchsorted(column, (start, start + width))
        member = np.zeros((len(sets), width), dtype=np.float32)
        member[owner[low:high], column[low:high] - start] = 1
        out += member[: len(one)] @ member[len(one) :].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of links (a, b) among n nodes that join what was apart."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def _part_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links inside long runs: rows (cell, part, tree, depth, key, copies, signature, grams) grouped by cell, a pair of parts.

    Returns rows (a, b, links): with b a link of the forest, without b the links of a, copies counted.
    """

    def run(cell: pa.Table) -> pa.Table:
        order = np.lexsort((cell["key"].to_numpy(zero_copy_only=False), cell["part"].to_numpy()))
        cell = cell.take(pa.array(order)).combine_chunks()
        part, key = cell["part"].to_numpy(), cell["key"].to_pylist()
        copies, tree, depth = cell["copies"].to_numpy(), int(cell["tree"][0].as_py()), int(cell["depth"][0].as_py())
        signature = _matrix(cell["signature"], TREES * DEPTH)
        sets = [_set(g) for g in cell["grams"].to_pylist()]
        left = np.flatnonzero(part == part[0])
        right = left if part[0] == part[-1] else np.flatnonzero(part == part[-1])
        if not cell["same"][0].as_py() and part[0] == part[-1]:
            right = right[:0]  # the other part has no rows
        shared = _shared([sets[i] for i in left], [sets[i] for i in right]) if len(right) else np.zeros((len(left), 0))
        size = np.array([len(s) for s in sets], dtype=np.float64)
        union = size[left][:, None] + size[right][None, :] - shared
        x, y = np.nonzero(shared >= threshold * union - 1e-9)
        x, y = left[x], right[y]
        ahead = x < y
        x, y = x[ahead], y[ahead]
        good = np.zeros(len(x), dtype=bool)
        for s in range(0, len(x), 65536):
            e = slice(s, s + 65536)
            good[e] = _first_meeting(signature[x[e]], signature[y[e]], np.full(len(x[e]), tree), np.full(len(x[e]), depth))
        x, y = x[good], y[good]
        count = np.bincount(x, copies[y], len(key)) + np.bincount(y, copies[x], len(key))
        kept, some = _forest(x, y, len(key)), np.flatnonzero(count)
        return pa.table(
            {
                "a": pa.array([key[x[i]] for i in kept] + [key[i] for i in some], pa.binary()),
                "b": pa.array([key[y[i]] for i in kept] + [None] * len(some), pa.binary()),
                "links": pa.array([0] * len(kept) + count[some].astype(np.int64).tolist(), pa.int64()),
            }
        )

    return rows.groupBy("cell").applyInArrow(run, "a binary, b binary, links long")


def link(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, membership and links of ``docs``.

    * classes: ``key, class_id`` (least id), ``copies``
    * members: ``doc_id, key``
    * links: ``a, b, links``: with b, a link between the classes a and b (all links of short runs, a spanning
      forest of those in long runs); without b, the number of rows that a is linked to, copies counted.
    """
    members = settle(signatures(docs))
    classes = settle(
        members.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("grams").alias("grams"))
    )
    indexed = classes.where("signature is not null")
    depth = measured_depth(indexed.select("key", "grams"), threshold, target)
    alone = F.ceil(F.lit(threshold / (1 - threshold)) - 1e-6)  # smaller sets are similar enough to equal ones only
    indexed = indexed.withColumn("depth", F.when(F.col("grams") < alone, DEPTH).otherwise(depth))
    entries = indexed.select("key", "depth", F.posexplode(_bands("signature", "depth")).alias("tree", "band"))
    # a table of its own: a run that holds a third of the texts can then be split in the join
    runs = settle(entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = settle(entries.join(runs, "band").join(classes.select("key", "copies", "signature", "grams"), "key"))
    short = met.where(F.col("n") <= SMALL).repartition("band")
    pairs = settle(_near_pairs(short.select("band", "tree", "depth", "key", "grams", "signature"), threshold))
    long = met.where(F.col("n") > SMALL).drop("grams")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(long.select("key")).distinct()
    needed = needed.join(classes.select("key", "class_id"), "key")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    texts = texts.join(needed, (texts["key"] == needed["key"]) & texts["doc_id"].eqNullSafe(needed["class_id"])).select(texts["key"], "text")
    sets = settle(gram_sets(texts).dropDuplicates(["key"]))
    exact = settle(_verified(pairs, sets, threshold))
    parts = F.ceil(F.col("n") / PART).cast("int")
    long = long.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.concat_ws(":", "band", F.least("part", "other"), F.greatest("part", "other"))
    long = long.withColumn("cell", cell).withColumn("same", F.col("part") == F.col("other"))
    inside = _part_links(long.select("cell", "same", "part", "tree", "depth", "key", "copies", "signature").join(sets, "key"), threshold)
    copies = classes.select("key", "copies")
    counted = exact.join(copies.withColumnRenamed("key", "a").withColumnRenamed("copies", "ca"), "a").join(
        copies.withColumnRenamed("key", "b").withColumnRenamed("copies", "cb"), "b"
    )
    links = (
        exact.select("a", "b", F.lit(0).cast("long").alias("links"))
        .unionByName(counted.select("a", F.lit(None).cast("binary").alias("b"), F.col("cb").alias("links")))
        .unionByName(counted.select(F.col("b").alias("a"), F.lit(None).cast("binary").alias("b"), F.col("ca").alias("links")))
        .unionByName(inside)
    )
    return classes.select("key", "class_id", "copies"), members.select("doc_id", "key"), settle(links)


def join(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, copy_of, class_id, n_links``.

    copy_of: least id with an equal text.  class_id: least id that links lead to.  n_links: number of other rows
    whose text is equal or at least as similar as the threshold.
    """
    classes, members, links = link(docs, threshold, target)
    found = components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("near"))
    least = found.join(classes.withColumnRenamed("key", "node").select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("least"))
    own = classes.select(F.col("key").alias("component"), F.col("class_id").alias("own"))
    roots = settle(least.join(own, "component", "left").select("component", F.least("least", "own").alias("group_id")))
    grouped = found.join(roots, "component").select(F.col("node").alias("key"), "group_id").unionByName(roots.select(F.col("component").alias("key"), "group_id"))
    classes = classes.join(grouped, "key", "left").join(degree, "key", "left")
    classes = classes.select(
        "key",
        F.col("class_id").alias("copy_of"),
        F.coalesce("group_id", "class_id").alias("class_id"),
        (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    return members.join(settle(classes), "key").select("doc_id", "key", "copy_of", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    The row with the least id stays; of several such rows one stays, whichever.  Rows without an id whose
    group has no id are told apart by their text.
    """
    groups = join(docs.select("doc_id", "text"), threshold)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("copy_of").eqNullSafe(F.col("class_id"))).select("doc_id", "key").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_key(F.col("text")).alias("key"))
    kept = whole.join(first.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")), (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.groupBy("key", "doc_id").agg(F.first("row").alias("row")).select("row.*")


def op2_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("key")
