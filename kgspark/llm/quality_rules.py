"""Quality rules: fixed rules on word counts, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``sample`` of them, those with the smallest
hash of their id) and sent to the tasks as node arrays; every document is scored whole.  More symbols,
repeated lines, repeated words, exclamation marks or separators never raise a document's score.

Defined results: null and empty texts have no words and fail the fixed rule; very long texts are judged whole; labels tied in
the hash of their id are taken by id; without labels of both kinds
there is no model and the fixed rule alone decides; conflicting labels of an id count by their mean;
labels without an id or a mark are not used; extra columns, also with clashing names, pass through
``filter_documents`` unchanged; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import boosting
from .common import table
from .wordhash import Block, blocks, gram_hashes, mix, whole_grams, word_hashes, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# name of each statistic and the direction in which it may move the score
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "upper": 0,
    "digits": 0,
    "marks": -1,
    "exclamations": -1,
    "distinct": 0,
    "line_words": 0,
    "separators": -1,
    "non_ascii": 0,
    "ended_lines": 0,
}
_MONOTONE = np.array(list(FEATURES.values()))


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_CONTINUED = np.arange(256) & 0xC0 == 0x80
_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(bytes(range(48, 58)))
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows x 5) and features (rows x len(FEATURES)) of a block of texts."""
    found = words(block)
    hashes = word_hashes(block, found)
    counts = np.diff(found.bounds)

    def per_row(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return np.diff(sums[block.offsets])

    heads = np.concatenate(([0], np.cumsum(~_CONTINUED[block.data], dtype=np.int64)))
    lengths = heads[found.ends] - heads[found.starts]
    word_chars = np.diff(np.concatenate(([0], np.cumsum(lengths)))[found.bounds])
    symbols = per_row(_SYMBOL[block.data])
    lines, dup_lines, ended = _lines(block, found)
    repeat = _repeated(hashes, found)
    pair = np.sort(mix(hashes) ^ mix(found.row.astype(np.uint64)))
    # distinct words: a hash of word and row, counted where it first stands in order
    owner = found.row[np.argsort(mix(hashes) ^ mix(found.row.astype(np.uint64)), kind="stable")]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = pair[1:] != pair[:-1]
    distinct = np.bincount(owner[new], minlength=block.rows)
    base = np.stack([counts, word_chars, symbols, dup_lines, repeat], axis=1)
    n, size = np.maximum(counts, 1), np.maximum(np.diff(block.offsets), 1)
    letters = np.maximum(per_row(_UPPER[block.data] | _LOWER[block.data]), 1)
    features = np.stack(
        [
            np.log1p(counts),
            word_chars / n,
            symbols / n,
            dup_lines / np.maximum(lines, 1),
            repeat / n,
            per_row(_UPPER[block.data]) / letters,
            per_row(_DIGIT[block.data]) / size,
            per_row(_MARK[block.data]) / n,
            per_row(block.data == ord("!")) / n,
            distinct / n,
            counts / np.maximum(lines, 1),
            per_row(block.data == ord("|")) / n,
            per_row(block.data > 127) / size,
            ended / np.maximum(lines, 1),
        ],
        axis=1,
    )
    return base, features


def _lines(block: Block, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: lines with a word, those equal to an earlier one, those that end in a mark."""
    if not len(found.starts):
        nothing = np.zeros(block.rows, np.int64)
        return nothing, nothing, nothing
    cuts = np.flatnonzero(block.data == ord("\n"))
    starts = np.unique(np.concatenate((block.offsets[:-1], cuts + 1)))
    starts = starts[starts < len(block.data)]
    line = np.unique(np.searchsorted(starts, found.starts, "right") - 1)
    start = starts[line]
    row = np.searchsorted(block.offsets, start, "right") - 1
    end = block.offsets[row + 1].copy()
    if len(cuts):
        at = np.searchsorted(cuts, start)
        end = np.minimum(end, np.where(at < len(cuts), cuts[np.minimum(at, len(cuts) - 1)], len(block.data)))
    whole = type(found)(start, end, None)
    key = word_hashes(block, whole) ^ mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[order][1:] == key[order][:-1]
    last = block.data[found.ends[np.searchsorted(found.starts, end, "left") - 1] - 1]
    count = lambda r: np.bincount(r, minlength=block.rows)
    return count(row), count(row[order][again]), count(row[_MARK[last]])


def _repeated(hashes: np.ndarray, found, n: int = 3) -> np.ndarray:
    """Per row: words in windows of n words that stand at least twice in the row's text."""
    rows = len(found.bounds) - 1
    starts, _ = whole_grams(found.bounds, n)
    if not len(starts):
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.maximum(np.diff(found.bounds) - n + 1, 0))
    key = gram_hashes(hashes, n)[starts] ^ mix(row.astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(hashes), dtype=bool)
    for i in range(n):
        marked[starts[twice] + i] = True
    return np.diff(np.concatenate(([0], np.cumsum(marked)))[found.bounds])


def with_features(docs: DataFrame, extra: str = "") -> DataFrame:
    """Features of each row of ``docs`` (columns doc_id and text, and the double ``extra`` if named)."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                features = statistics(block)[1]
                kept = [batch[extra].slice(block.first, block.rows)] if extra else []
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in features.T)], names=[extra] * bool(extra) + names)

    schema = ", ".join([f"{extra} double"] * bool(extra) + [f"{n} double" for n in names])
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> boosting.Trees | None:
    """Trees for ``labels.quality``, from at most ``sample`` labelled documents; None without both marks."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("mark"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("mark").cast("double").alias("mark"))
    data = with_features(rows, "mark").toPandas().to_numpy()
    if not len(data):
        return None
    data = data[np.lexsort(data.T)]  # the fit does not depend on the order of tasks
    y = (data[:, 0] >= 0.5).astype(float)
    return boosting.fit(data[:, 1:], y, _MONOTONE) if 0 < y.sum() < len(y) else None


def judge(rows: DataFrame, model: boosting.Trees | None, threshold: float = 0.5) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``kept`` and ``quality_score`` to rows with a column ``text``.

    The text itself is not carried on; all other columns are.
    """
    names = [n for n in rows.columns if n != "text"]
    kinds = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                base, features = statistics(block)
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                score = model.probability(features) if model else np.ones(len(base))
                columns = [batch[n].slice(block.first, block.rows) for n in names]
                columns += [pa.array(c.astype(np.int64)) for c in base.T]
                columns += [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *BASE, "base_failed", "kept", "quality_score"])

    schema = StructType(kinds)
    for name in BASE:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean").add("quality_score", "double"))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text"))
    return judge(whole, fit(docs, labels), threshold).where("kept").select("row.*")


def op1_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
