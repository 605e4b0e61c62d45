"""Toxicity of texts behind disguises.

The characters of all texts give a trigram model; disguised words are restored under it (``deobfuscation``), and the score is of the
restored text.  Its features are stems (words and their beginnings of three letters or more) that are there at all, twice or more, or
once in a hundred words or oftener.  Labelled texts give each feature a likelihood ratio; the strongest go into a logistic model with an L1 penalty, which keeps few of them.

Learning uses at most ``sample`` labelled rows of each mark (those with the smallest hash of their id), none of them with
crc32(doc_id as text) mod 5 = 0, equal and nearly equal texts once.  Only the text is an input of a score.

Defined results: null texts score as empty ones; an empty text has the score of no evidence; very long texts are restored and
scored whole; repeated rows score alike; labels tied in the hash of their id are taken by id; conflicting labels of an id or of equal texts count by
their mean; without both marks every score is the share of toxic marks, or 0.5 without any; an empty table gives no rows; only the named
columns are read, so extra columns, clashing names among them, do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deobfuscation as channel
from .common import crc_of_id, settle, table, text_key

PREFIXES = range(3, 8)
DENSE = 100
KEPT_WORDS = 200_000


class Restorer:
    """Restores texts, and keeps what it has decoded: ``KEPT_WORDS`` tokens at most, then it begins anew."""

    def __init__(self, model: channel.Characters):
        self.model = model
        self.kept: dict[str, str] = {}

    def restore(self, texts: list[str]) -> list[str]:
        """Texts in lower case, with disguised words written out."""
        texts = [t.lower() for t in texts]
        traced, lone = channel.traced(texts)
        apart = [{m.group() for m in channel.APART.finditer(t) if sum(c in channel.NUMBER for c in m.group()) > 1} if some else set() for t, some in zip(texts, lone)]
        strange = [{t for t in set(text.split()) if channel.TRACE.search(t)} if some else set() for text, some in zip(texts, traced)]
        new_apart = sorted(set().union(*apart) - self.kept.keys())
        new = sorted(set().union(*strange) - self.kept.keys() - set(new_apart))
        lattices = [channel.apart_lattice(t) for t in new_apart] + [channel.lattice(t) for t in new]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {t: self.kept[t] for t in set().union(*apart, *strange) if t in self.kept}
        self.kept |= dict(zip(new_apart + new, channel.decode(lattices, self.model)))
        return [self._written_out(*row) for row in zip(texts, apart, strange)]

    def _written_out(self, text: str, apart: set[str], strange: set[str]) -> str:
        if apart:
            text = channel.APART.sub(lambda m: self.kept.get(m.group(), m.group()), text)
        if strange:
            text = channel.re.sub(r"\S+", lambda m: self.kept.get(m.group(), m.group()) if m.group() in strange else m.group(), text)
        return text


def restored(docs: DataFrame, model: channel.Characters) -> DataFrame:
    """``doc_id, text`` with every text restored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for part in parts(batches):
            texts = restorer.restore([t.as_py() or "" for t in part["text"]])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def parts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes; one longer text is a batch of its own."""
    for batch in batches:
        n = min(len(batch), max(1, batch.nbytes // limit))
        for rows in np.array_split(np.arange(len(batch)), n) if len(batch) else []:
            yield batch.slice(rows[0], len(rows))


def stems(word: str) -> list[str]:
    """A word as a whole, marked by a space, and its beginnings."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + [word + " "]


def levels(held: dict[str, int], n_words: int) -> set[str]:
    """Features of a text out of the counts of its stems: there at all, twice or more, once in ``DENSE`` words or oftener."""
    out = {f"{s}|1" for s in held}
    out |= {f"{s}|2" for s, n in held.items() if n > 1}
    return out | {f"{s}|d" for s, n in held.items() if n > 1 and n * DENSE >= n_words}


def features(text: str) -> set[str]:
    words = Counter(channel.WORD.findall(text))
    held: Counter = Counter()
    for word, n in words.items():
        for s in stems(word):
            held[s] += n
    return levels(held, words.total())


@dataclass
class Model:
    characters: channel.Characters | None
    weight: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.stems = {f[:-2] for f in self.weight}

    def score(self, text: str, known: dict[str, tuple[str, ...]]) -> float:
        """Probability of the toxic mark; ``known`` keeps the weighted stems of words seen before."""
        words = Counter(channel.WORD.findall(text))
        held: Counter = Counter()
        for word, n in words.items():
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(s for s in stems(word) if s in self.stems)
            for s in own:
                held[s] += n
        z = self.bias + sum(self.weight.get(f, 0.0) for f in sorted(levels(held, words.total())))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sparse_logistic(rows: list[np.ndarray], mark: np.ndarray, n: int, penalty: float = 0.01, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of features, by accelerated proximal steps; the bias is not penalised."""
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    column = np.concatenate([np.append(r, n) for r in rows]).astype(np.int64)  # feature n is the bias

    def product(weight: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=weight[column], minlength=len(rows))

    def back(error: np.ndarray) -> np.ndarray:
        return np.bincount(column, weights=error[row], minlength=n + 1)

    probe = np.ones(n + 1)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        probe = back(product(probe / np.linalg.norm(probe)))
    rate, shrink = 3.6 / np.linalg.norm(probe), np.append(np.full(n, penalty), 0)
    weight = ahead = np.zeros(n + 1)
    t = 1.0
    for _ in range(steps):
        new = ahead - rate * back(1 / (1 + np.exp(-np.clip(product(ahead), -30, 30))) - mark)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * shrink, 0)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        weight, ahead, t = new, new + (t - 1) / following * (new - weight), following
    return weight[:n], float(weight[n])


def apart(rows: DataFrame) -> DataFrame:
    """One of equal texts, and of texts that agree in the least hash of their runs of five words; marks are averaged.

    Near copies would else pass for so many independent witnesses of every word they hold.
    """
    rows = rows.withColumn("key", text_key(F.col("text")))
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), F.avg("toxic").alias("toxic"))

    def least_run(seed: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1)))
        return F.array_min(F.transform(places, lambda i: F.xxhash64(F.lit(seed), F.slice("_words", i, 5))))

    for seed in (1, 2):
        hashes = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
        hashed = rows.select("*", F.explode(F.array(hashes)).alias("_words"))  # one row each; keeps the words from being cut anew for every run
        best = F.min_by("text", "key").alias("text")
        rows = hashed.groupBy(least_run(seed).alias("sketch")).agg(best, F.min("key").alias("key"), F.avg("toxic").alias("toxic")).drop("sketch")
    return rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, strongest: int = 2_000, least_texts: int = 4) -> Model:
    """Learns from at most ``sample`` labelled rows of each mark; the driver gets ``strongest`` features and which texts have them.

    The more features are compared, the more evidence each must have: a likelihood ratio that chance reaches once in all of them.
    """
    spark = docs.sparkSession
    seen = crc_of_id(F.col("doc_id")) % 5 != 0
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & seen).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = marks.where("toxic").orderBy(*order).limit(sample).unionByName(marks.where("not toxic").orderBy(*order).limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = settle(apart(rows.select("text", F.col("toxic").cast("double").alias("toxic"))).select("text", (F.col("toxic") >= 0.5).alias("toxic")))
    number = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(number) < 2:
        total = sum(number.values())
        share = min(max(number.get(True, 0) / total, 1e-9), 1 - 1e-9) if total else 0.5
        return Model(None, {}, float(np.log(share / (1 - share))))
    model = channel.characters(channel.trigram_counts(docs))
    shared = spark.sparkContext.broadcast(model)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, set[str]]]:
        restorer = Restorer(shared.value)
        for part in parts(batches):
            for toxic, text in zip(part["toxic"].to_pylist(), restorer.restore([t.as_py() or "" for t in part["text"]])):
                yield toxic, features(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, found in sets(batches):
            held[toxic].update(found)
        every = sorted(held[0].keys() | held[1].keys())
        for at in range(0, len(every), 50_000):
            some = every[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([held[0][f] for f in some]), pa.array([held[1][f] for f in some])], names=["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = number[True] / sum(number.values())
    both = F.col("clean") + F.col("toxic")

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share)))
    counts = settle(counts.where(both >= least_texts))
    strong = counts.withColumn("ratio", ratio).where((F.col("ratio") >= 2 * math.log(max(counts.count(), 2))) & (F.col("toxic") > both * share))
    names = [r[0] for r in strong.orderBy(F.desc("ratio"), "feature").limit(strongest).collect()]
    index = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, found in sets(batches):
            held = pa.array([sorted(index.value[f] for f in found if f in index.value)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([toxic]), held], names=["toxic", "held"])

    data = sorted((r[0], list(r[1])) for r in rows.mapInArrow(which, "toxic boolean, held array<int>").collect())  # the fit does not depend on the order of tasks
    if not names:
        return Model(model, {}, float(np.log(share / (1 - share))))
    weight, bias = sparse_logistic([np.array(h, dtype=np.int64) for _, h in data], np.array([t for t, _ in data], dtype=float), len(names))
    return Model(model, {name: float(w) for name, w in zip(names, weight) if w}, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Columns ``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(model.characters) if model.characters else None
        known: dict[str, tuple[str, ...]] = {}
        for part in parts(batches):
            texts = [t.as_py() or "" for t in part["text"]]
            texts = restorer.restore(texts) if restorer else texts
            if len(known) > KEPT_WORDS:
                known.clear()
            value = np.array([model.score(t, known) for t in texts])
            columns = [part["doc_id"], part["held_out"], pa.array(value), pa.array((value >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op12_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
