"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and benchmark items become lists of normalised words (ASCII letters in lower case, ASCII punctuation
dropped, empty words left out).  An item of n words is in a document if some stretch of the document has a word
edit distance of at most ``floor((1 - similarity) * n)`` to it.

The CGK walk copies a window word by word to an output, and after each step moves on or stays, as a random
function of the step and the word decides; windows at a small edit distance get outputs at a small Hamming
distance.  Each repetition draws a new walk; from its output, pairs of sampled places are hash keys, and windows
that share a key with an item are candidates.  The number of repetitions is measured when the items are
prepared: items with as many random edits as allowed, inside other text, must be found at the target rate, less
two standard errors of the measurement.  Items are handled in classes of like length, windows are as long as the
items of the class.  Before the walk, windows with too few words of any item are passed over; such windows cannot
be close enough, so nothing is lost there.  A class that misses the target after ``_MOST_REPEATS`` repetitions has
no walk: all its items are verified at all windows left.
Candidates are verified exactly, by edit distance with free ends around the window.

The walk of a window takes twice the items' length in steps less one and may read on into the text behind the window, for
items and documents alike; keys use only places within these steps.

The items are the query set; they go to the tasks in blocks of at most ``block_items``, one pass over the
documents each.

Defined results: null texts and items without a word match nothing; very long texts are searched whole; of equally distant
places the first is told; an item shorter than 1 / (1 - similarity)
words must stand exactly; repeated documents give a row each, repeated items too; empty tables give no rows;
extra columns, also with clashing names, pass through ``clean_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import table
from .wordhash import Block, blocks, word_hashes, words

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0
_PAIRS, _LEAST_REPEATS, _MOST_REPEATS, _CHUNK, _CLASS = 8, 2, 24, 1 << 16, 1.12
_MEASURED = 1000


def normalised(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of a block and the bounds of its rows among them."""
    data = _NORMAL[block.data]
    kept = data != 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[block.offsets]
    plain = Block(block.first, data[kept], offsets)
    found = words(plain)
    return word_hashes(plain, found), found.bounds


@dataclass
class Items:
    """Items of one length class, as codes of the shared vocabulary."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    steps: int = 0
    repeats: int = 0  # 0: every window is verified
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    maybe: np.ndarray | None = None  # for each key a bitmap of its hashes
    member: np.ndarray | None = None  # whether a code is a word of some item

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(c) for c in self.codes])


class Benchmark:
    """A block of items prepared for the search."""

    def __init__(self, rows: list[tuple], similarity: float, target: float, seed: int = 11):
        self.seed, hashed = seed, []
        if rows:
            for block in blocks(pa.array([r[1] for r in rows], pa.string())):
                hashes, bounds = normalised(block)
                hashed += [hashes[bounds[i] : bounds[i + 1]] for i in range(block.rows)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.other, self.end = len(self.vocabulary), len(self.vocabulary) + 1
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        groups: dict[int, Items] = {}
        for (item_id, _), h in zip(rows, hashed):
            if len(h):
                group = groups.setdefault(int(np.log(len(h)) / np.log(_CLASS)), Items([], [], np.zeros(0, int)))
                group.ids.append(item_id)
                group.codes.append(np.searchsorted(self.vocabulary, h).astype(np.int32))
        self.classes = [groups[k] for k in sorted(groups)]
        for c in self.classes:
            c.edits = np.floor((1 - similarity) * c.lengths + 1e-9).astype(int)
            c.steps = int(max(1, 2 * c.lengths.min() - 1))
            c.repeats = self._repeats(c, target)
            text, starts = self._joined(c.codes)
            c.member = np.zeros(self.end + 1, dtype=np.int8)
            c.member[np.concatenate(c.codes)] = 1
            c.maybe = np.zeros((c.repeats * _PAIRS, 1 << 16), dtype=bool)
            c.keys = []
            for key in self._keys(c, text, starts, c.repeats):
                c.maybe[len(c.keys), _short(key)] = True
                order = np.argsort(key, kind="stable")
                c.keys.append((key[order], order))

    def _joined(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ended = [np.append(c, self.end) for c in lists]
        return np.concatenate(ended).astype(np.int32), np.concatenate(([0], np.cumsum([len(c) for c in ended])))[:-1]

    def _keys(self, c: Items, text: np.ndarray, starts: np.ndarray, repeats: int, first: int = 0) -> Iterator[np.ndarray]:
        """Hash keys of the windows that start at ``starts``, ``_PAIRS`` for each repetition."""
        for r in range(first, repeats):
            random = np.random.default_rng([self.seed, c.steps, r])
            sampled = np.sort(random.integers(0, c.steps, (_PAIRS, 2)), axis=1)
            onward = random.integers(0, 2, (c.steps, self.end + 1), dtype=np.int8)
            onward[:, self.end] = 0
            wanted, out, at = set(sampled.ravel().tolist()), {}, starts.astype(np.int64)
            for step in range(max(wanted) + 1):
                here = text[at]
                if step in wanted:
                    out[step] = here.astype(np.int64)
                at = at + onward[step][here]
            for one, other in sampled:
                yield out[one] * (self.end + 1) + out[other]

    def _repeats(self, c: Items, target: float) -> int:
        """Repetitions that find items with the most edits allowed at the target rate; 0 if no number up to the most does."""
        random, changed, source = np.random.default_rng([self.seed, len(c.codes)]), [], []
        for i in random.integers(0, len(c.codes), _MEASURED):
            item, edits = c.codes[i].tolist(), int(c.edits[i])
            for _ in range(edits):
                at, kind = int(random.integers(0, len(item))), int(random.integers(0, 3))
                item[at : at + (kind != 0)] = [] if kind == 1 and len(item) > 1 else [self.other]
            changed.append(np.array(item + [self.other] * c.steps, dtype=np.int32))  # a document goes on after the item
            source.append(i)
        both = [self._keys(c, *self._joined(lists), _MOST_REPEATS) for lists in (changed, [c.codes[i] for i in source])]
        found = np.zeros(len(source), dtype=bool)
        for n, (a, b) in enumerate(zip(*both), 1):
            found |= a == b
            if n % _PAIRS == 0 and n >= _PAIRS * _LEAST_REPEATS and found.mean() - 2 * found.std() / len(found) ** 0.5 >= target:
                return n // _PAIRS
        return 0

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, object, int, int, int, int]]:
        """(row, item id, item words, distance, first word, end word) of the best place of every item found in every row."""
        rows = len(bounds) - 1
        code = np.full(len(hashes) + rows, self.other, dtype=np.int32)
        row = np.repeat(np.arange(rows), np.diff(bounds))
        place = np.arange(len(hashes)) + row
        ends = bounds[1:] + np.arange(rows)
        code[ends] = self.end
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        code[place[maybe[same]]] = at[same]
        out = []
        for c in self.classes:
            start = self._possible(c, code)
            if not c.repeats:
                for i in range(len(c.codes) if len(start) else 0):
                    out += self._verify(c, i << 40 | start, code, ends)
                continue
            hits = []
            for cut in range(0, len(start), _CHUNK):
                some = start[cut : cut + _CHUNK]
                for (sorted_keys, order), maybe, key in zip(c.keys, c.maybe, self._keys(c, code, some, c.repeats)):
                    likely = np.flatnonzero(maybe[_short(key)])
                    if len(likely):
                        low, high = np.searchsorted(sorted_keys, key[likely], "left"), np.searchsorted(sorted_keys, key[likely], "right")
                        n = high - low
                        which = np.repeat(np.arange(len(n)), n)
                        rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                        hits.append(order[low[which] + rank].astype(np.int64) << 40 | some[likely[which]])
            if hits:
                hits = np.unique(np.concatenate(hits))
            if len(hits):
                out += self._verify(c, hits, code, ends)
        return out

    @staticmethod
    def _possible(c: Items, code: np.ndarray) -> np.ndarray:
        """Starts of all stretches that may be close enough to an item of the class, judged by words that no item has.

        A close stretch has at least n - edits words, at most ``edits`` of the first n - edits are in no item, and the
        next n + edits words hold at least n - edits words of items, all but ``edits`` of an item's different words
        among them.
        """
        inner, most = int((c.lengths - c.edits).min()), int(c.edits.max())
        if len(code) < inner:
            return np.zeros(0, np.int64)
        known = np.zeros(len(code) + 1, dtype=np.int32)
        np.cumsum(c.member[code], out=known[1:])
        start = np.flatnonzero((known[inner:] - known[:-inner] >= inner - most) & (code[: len(code) - inner + 1] < len(c.member) - 1))
        end = np.minimum(start + int((c.lengths + c.edits).max()), len(code))
        kept = known[end] - known[start] >= inner
        start, end = start[kept], end[kept]
        # a run of one word repeated has few different words
        fresh = c.member[code] == 1
        fresh[1:] &= code[1:] != code[:-1]
        np.cumsum(fresh, out=known[1:])
        different = min(len(np.unique(w)) - e for w, e in zip(c.codes, c.edits))
        return start[known[end] - known[start] + 1 >= different]

    def _verify(self, c: Items, hits: np.ndarray, code: np.ndarray, ends: np.ndarray) -> list[tuple]:
        item, start = hits >> 40, hits & ((1 << 40) - 1)
        row = np.searchsorted(ends, start, "left")
        first = np.where(row > 0, ends[row - 1] + 1, 0)
        # neighbouring windows of an item are verified together
        stride = np.maximum(c.edits[item], 1)
        _, kept = np.unique(np.stack([item, row, (start - first) // stride]), axis=1, return_index=True)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i in np.unique(item[kept]):
            mine = kept[item[kept] == i]
            want, edits = c.codes[i], int(c.edits[i])
            width = len(want) + 4 * edits + 2
            for cut in range(0, len(mine), 4096):
                some = mine[cut : cut + 4096]
                low = np.maximum(start[some] - edits, first[some])
                at = low[:, None] + np.arange(width)
                window = np.where(at < ends[row[some]][:, None], code[np.minimum(at, len(code) - 1)], self.end)
                enough = _common_words(want, window, self.end) >= len(want) - edits
                for r, l, d, e in zip(row[some][enough], low[enough], *ending_distances(want, window[enough])):
                    if d <= edits:
                        best[(int(r), int(i))] = min(best.get((int(r), int(i)), (edits + 1, 0)), (int(d), int(l + e)))
        out = []
        for (r, i), (d, e) in best.items():
            want = c.codes[i]
            base = int(ends[r - 1] + 1) if r else 0
            low = max(base, e - len(want) - d)
            back = code[low:e][::-1]
            distance = _row(want[::-1], back[None, :], fixed=True)[0]
            length = int(np.flatnonzero(distance == distance.min())[0])
            out.append((r, c.ids[i], len(want), d, e - length - base, e - base))
        return out


def _short(key: np.ndarray) -> np.ndarray:
    """16-bit hashes of keys."""
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _common_words(want: np.ndarray, windows: np.ndarray, end: int) -> np.ndarray:
    """Number of words of ``want`` that each window has, repeats counted."""
    own, count = np.unique(want, return_counts=True)
    local = np.full(end + 1, len(own), dtype=np.int64)
    local[own] = np.arange(len(own))
    place = local[windows] + np.arange(len(windows))[:, None] * (len(own) + 1)
    have = np.bincount(place.ravel(), minlength=len(windows) * (len(own) + 1)).reshape(len(windows), -1)[:, :-1]
    return np.minimum(have, count).sum(axis=1)


def _row(want: np.ndarray, windows: np.ndarray, fixed: bool = False) -> np.ndarray:
    """Edit distances of ``want`` to the stretches of each window that end at 0, 1, ... (from its start, if fixed; else the best)."""
    n, width = windows.shape
    kind = np.int16 if width + len(want) < 32000 else np.int32
    along = np.arange(width + 1, dtype=kind)
    last = np.broadcast_to(along if fixed else along * 0, (n, width + 1)).astype(kind)
    for i, word in enumerate(want, 1):
        now = np.empty_like(last)
        now[:, 0] = i
        now[:, 1:] = np.minimum(last[:, :-1] + (windows != word), last[:, 1:] + 1)
        last = np.minimum.accumulate(now - along, axis=1) + along
    return last


def ending_distances(want: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of ``want`` to a stretch of each window, and the first end where it is reached."""
    distance = _row(want, windows)
    end = distance.argmin(axis=1)
    return distance[np.arange(len(end)), end], end


def _prepared(benchmark: DataFrame, similarity: float, target: float, block_items: int) -> Iterator[Benchmark]:
    """Blocks of items; each block is of bounded size and is collected by itself."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    count = items.count()
    n = max(1, -(-count // block_items))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))
        if rows:
            yield Benchmark(rows, similarity, target)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.99, block_items: int = 2000) -> DataFrame:
    """``doc_id, item_id, item_words, distance, first_word, end_word``: a row for each document and item in it."""
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"]])
    for name in ("item_words", "distance", "first_word", "end_word"):
        schema = schema.add(name, "long")
    spark, out = docs.sparkSession, None
    item_kind = to_arrow_type(schema["item_id"].dataType)
    for prepared in _prepared(benchmark, similarity, target, block_items):
        shared = spark.sparkContext.broadcast(prepared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch["text"]):
                    found = sorted(shared.value.search(*normalised(block)), key=lambda f: (f[0], str(f[1])))
                    if found:
                        ids = batch["doc_id"].take(pa.array([f[0] + block.first for f in found]))
                        columns = [ids, pa.array([f[1] for f in found], item_kind)] + [pa.array([f[k] for f in found], pa.int64()) for k in range(2, 6)]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.99, block_items: int = 2000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    for prepared in _prepared(benchmark, similarity, target, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(prepared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for block in blocks(batch["text"]):
                    clean[[f[0] + block.first for f in shared.value.search(*normalised(block))]] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
