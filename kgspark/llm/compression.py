"""Compression classifier: zstandard dictionaries of good and of bad labelled text.

A text is compressed with each dictionary, in pieces of ``PIECE`` bytes so that the dictionary matters as
much at the end of a long text as at its start.  The difference of the two compressed sizes, divided by their
sum, and the ratio of compressed to raw size go through a logistic calibration fitted on labelled rows that
gave no text to the dictionaries.

Learning uses at most ``sample`` labelled rows of each mark (those with the smallest hash of their id),
none of them with crc32(doc_id as text) mod 4 = 2.  Only the text is an input of a score.

Defined results: very long texts are compressed whole, piece by piece; labels tied in the hash of their id are taken by id;
null texts score as empty texts; repeated rows score alike; extra columns, clashing names among them, are not read; an empty text has the calibrated score of no evidence;
without both marks in each half every score is the share of good marks, or 0.5 without any; conflicting labels of an id
count by their mean; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

PIECE = 8192
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(sizes), self.prior)
        x = (inputs(sizes) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(design(x) @ self.weight, -30, 30)))


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """A raw-content dictionary of at most ``size`` bytes; the longest pieces come first, farthest from the text."""
    return b"\n".join(sorted(pieces, key=lambda t: (-len(t), t)))[-size:] or b"\0" * 64


class Sizer:
    """Compressed sizes of texts with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            for d in (good, bad)
        ]
        for c in self.both:
            c.compress(b"")

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.both)
        return len(text), good, bad

    def column(self, texts: pa.Array) -> np.ndarray:
        column = pc.fill_null(texts.cast(pa.large_binary()), b"")
        return np.array([self.sizes(t.as_buffer().to_pybytes()) for t in column], dtype=np.int64).reshape(-1, 3)


def inputs(sizes: np.ndarray) -> np.ndarray:
    """Normalised difference, compression ratio and log size; all 0 for an empty text."""
    raw, good, bad = sizes.T.astype(float)
    some = raw > 0
    difference = np.where(some, (bad - good) / np.maximum(bad + good, 1), 0)
    ratio = np.where(some, np.log((good + bad) / 2 / np.maximum(raw, 1) + 1e-3), 0)
    return np.stack([difference, ratio, np.log1p(raw)], axis=1)


def design(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), *x.T, x[:, 0] * x[:, 1], x[:, 1] ** 2, x[:, 0] * x[:, 2], x[:, 2] ** 2], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the intercept is not penalised."""
    weight, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * weight)
        weight = weight + step
        if np.abs(step).max() < 1e-8:
            break
    return weight


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, size: int = 110_000) -> Model:
    """Learns from at most ``sample`` labelled documents of each mark, none of them held out.

    Half of them give one piece each to the dictionaries, at a place that a hash chooses and as long as lets all
    pieces of a mark fill its dictionary; with these the other half is measured whole, on the executors, and
    calibrates the score.
    """
    seen = crc_of_id(F.col("doc_id")) % 4 != 2
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & seen).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = marks.where("good").orderBy(*order).limit(sample).unionByName(marks.where("not good").orderBy(*order).limit(sample))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("good", "text", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("measured"))
    number = {(r[0], r[1]): r[2] for r in rows.groupBy("good", "measured").count().collect()}
    total = sum(number.values())
    prior = sum(n for (mark, _), n in number.items() if mark) / total if total else 0.5
    if len(number) < 4:
        return Model(b"", b"", np.zeros(3), np.ones(3), np.zeros(8), prior)
    share = {mark: max(64, (size + 1) // number[mark, False] - 1) for mark in (True, False)}
    length = F.when(F.col("good"), share[True]).otherwise(share[False])
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - length + 1, F.lit(1))).cast("int") + 1
    pieces = rows.where("not measured").select("good", F.col("text").substr(place, length).alias("piece")).collect()
    good, bad = (dictionary([bytes(p) for g, p in pieces if g == mark], size) for mark in (True, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(good, bad)
        for batch in batches:
            sizes = sizer.column(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["good"], *map(pa.array, sizes.T)], names=["good", "raw", "by_good", "by_bad"])

    sizes = rows.where("measured").mapInArrow(run, "good boolean, raw long, by_good long, by_bad long").toPandas().to_numpy(dtype=np.int64)
    sizes = sizes[np.lexsort(sizes.T)]  # the fit does not depend on the order of tasks
    x, y = inputs(sizes[:, 1:]), sizes[:, 0].astype(float)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Model(good, bad, center, scale, logistic(design((x - center) / scale), y), prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Columns ``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizer = Sizer(model.good or b"\0" * 64, model.bad or b"\0" * 64)
        for batch in batches:
            value = model.score(sizer.column(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
