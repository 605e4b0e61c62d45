"""Importance resampling towards the distribution of a target text set.

An untrained Regex Split of the tokenizers library cuts the ASCII-lowered text into words with their offsets.  Windows over the
offset pairs give every run of 1 to ``longest`` words; the words of a run, joined by one space, go to a bucket by CRC.  Bucket
histograms of the corpus and of the target give each bucket a gain; a document's weight is the sum of the gains of its
features.  Adding seeded Gumbel noise and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

Every text is cut once: the buckets of its features are written as Parquet in the shared folder and read for the histogram
and for the weights.  Only the histograms, ``buckets`` rows at most, go to the driver.

Defined results: null and empty texts have no features and weight 0; a very long text is cut line by line, but windows cross
lines; a null id has noise of its own, that of the empty string; repeated rows are rows of their own, with equal scores; ties go to the smaller
doc_id, null last, then in any order between rows alike; an empty target or an empty corpus has zeros in its histogram; an empty table
gives no rows; only ``doc_id`` and ``text`` are read, so extra columns, clashing names among them, do not matter.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from kgspark.operators.lineage import shared_folder

from .common import settle, table

SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = "2024"

Span = tuple[int, int]


def splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(SPLIT), behavior="removed", invert=True)


def words_with_offsets(split: pre_tokenizers.PreTokenizer, text: str) -> tuple[list[str], list[Span]]:
    """Words of the text with A-Z in lower case, and their offsets in code points."""
    words: list[str] = []
    offsets: list[Span] = []
    at = 0
    for line in text.encode().lower().decode().split("\n"):  # bytes.lower changes A-Z only; a line end is never inside a word
        for word, (start, end) in split.pre_tokenize_str(line):
            words.append(word)
            offsets.append((at + start, at + end))
        at += len(line) + 1
    return words, offsets


def windows(offsets: list[Span], longest: int) -> Iterator[tuple[int, int, Span]]:
    """First and last word of every run of 1 to ``longest`` words, with the stretch of the text that it spans."""
    for n in range(1, longest + 1):
        for i, (one, other) in enumerate(zip(offsets, offsets[n - 1 :])):
            yield i, i + n, (one[0], other[1])


def features(split: pre_tokenizers.PreTokenizer, text: str, longest: int) -> tuple[int, list[str]]:
    """Number of words, and every feature of a text."""
    words, offsets = words_with_offsets(split, text)
    if longest == 1:
        return len(words), words
    return len(words), [" ".join(words[a:b]) for a, b, _ in windows(offsets, longest)]


def _cell(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, cells``: the buckets of all features of each row, packed; written once, read as often as needed."""
    spark, cell = docs.sparkSession, _cell(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            size = max(1, batch["text"].nbytes // (1 << 22))  # parts of about 4 MB of text
            for rows in np.array_split(np.arange(len(batch)), min(size, len(batch))):
                part = batch.slice(rows[0], len(rows))
                n_words, n_features, cells = [], [], []
                for text in part["text"]:
                    n, found = features(split, text.as_py() or "", longest)
                    n_words.append(n)
                    n_features.append(len(found))
                    code = np.fromiter((zlib.crc32(f.encode()) for f in found), dtype=np.uint32, count=len(found))
                    cells.append((code % buckets).astype(cell).tobytes())
                columns = [part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, cells binary")
    folder = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _packed(column: pa.Array, cell: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a column in one array, and where each row's cells begin and end."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(cell) if data is not None and data.size else np.zeros(0, cell)
    return values, (bounds - bounds[0]) // cell.itemsize


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: every task adds up its own, Spark adds up the tasks."""
    cell = _cell(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            held += np.bincount(_packed(batch["cells"], cell)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.select("cells").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the corpus, rounded down."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [((float(t) + 1) * (all_corpus + n)) / ((float(s) + 1) * (all_target + n)) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` from the packed buckets of each row."""
    cell = _cell(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = _packed(batch["cells"], cell)
            sums = np.concatenate(([0], np.cumsum(gain[values])))
            weight = pa.array(sums[bounds[1:]] - sums[bounds[:-1]])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_features"], weight], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel value that the seed and the id decide, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with ``doc_id, n_features, weight, score, rank``; rank is null for rows that are not drawn.

    Of the rows with ``least_words`` words or more, ``share`` (a fraction) is drawn.  Rows are sorted into ranges; a row's rank is its
    place in its range after the rows of the ranges before, of which only the counts go to the driver.
    """
    spark = docs.sparkSession
    rows = bucketed(docs, longest, buckets)
    aims = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(histogram(rows, buckets), histogram(bucketed(aims, longest, buckets), buckets))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    order = (F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))  # the last spreads rows that are alike
    ranges = settle(scored.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranges.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = sorted(placed.groupBy("part").agg(F.count("*"), F.sum(F.col("fit").cast("long"))).collect())  # one row for each range
    drawn, starts, before = sum(c[2] for c in counts) * share[0] // share[1], [], 0
    for part, n, _ in counts:
        starts.append((part, before))
        before += n
    placed = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    rank = F.col("start") + F.col("place") + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op11_crc_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
cut AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words,
    row_number() OVER () AS r FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 0 FROM benchmark),
counted AS (SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(words) AS word FROM cut) GROUP BY ALL),
coded AS (
  SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted), crc_table),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted JOIN coded USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums),
weights AS (SELECT r, sum(n * g)::BIGINT AS weight FROM counted JOIN coded USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM ranked
"""
