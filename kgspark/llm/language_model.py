"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

The corpus is counted first: a table of word hashes and counts over all training documents, distributed by
hash.  Words above a count that leaves at most ``head`` of them go to the tasks; the counts of all other words reach
the documents by a join.  The most frequent words with a count of 3 or more are the vocabulary of the model, at most
``vocabulary`` of them, so that the vectors stay below ``8 * width`` bytes a word in every task.

The output is factored.  The most frequent words are classes of their own, the next ones share classes of ``GROUP`` words of
like frequency, and all words outside the vocabulary share one class.  The model gives the probability of a class and that of
a word in its class after the two words before it, both normalised by batched matrix products; in the class of the words
outside, words have their smoothed relative counts.  So the probabilities of all tokens add up to one.

Training is iterative parameter mixing: in each round every partition of that round's training documents starts
from the shared parameters, takes noise-contrastive steps over all its tokens, and the results are averaged
by tokens in a tree of sums.  Every training token is used once.  The result depends on how the documents are dealt to
partitions, as every partition takes its own steps; for the same files and settings it is the same.

Words are told apart by 64-bit hashes.  Defined results: null texts are empty texts, which have one token, the end;
very long texts are learned and scored whole, in pieces of ``PIECE`` tokens; without training documents every token has the
same base probability; rows without an id are held out or not by the crc32 of the empty text; words tied in frequency enter
the vocabulary by their hash; repeated rows are rows of their own; an empty table gives no rows; only the named
columns are read, so extra columns with clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, settle, table
from .wordhash import Block, blocks, lower_table, word_hashes, words

_LOWER = lower_table()
END = np.uint64(0x2545F4914F6CDD1D)  # the hash of the end token
_MOST_TOKENS = 1 << 21
#: Words that are classes of their own, words of each further class, tokens scored at a time.
SINGLE, GROUP, PIECE = 128, 128, 1 << 16


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block, an end after each row's words, and the bounds of the rows."""
    found = words(block)
    bounds = found.bounds + np.arange(block.rows + 1)
    out = np.full(bounds[-1], END, dtype=np.uint64)
    out[np.arange(len(found.starts)) + found.row] = word_hashes(block, found, _LOWER)
    return out, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (64-bit hash) and ``n`` over all tokens of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["word", "n"])

        for batch in batches:
            for block in blocks(batch["text"]):
                held.append(tokens(block)[0])
                size += len(held[-1])
                if size > _MOST_TOKENS:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """Frequent words: sorted hashes, counts, number in the vocabulary, and a slot table for quick look-up."""

    word: np.ndarray
    count: np.ndarray
    kind: np.ndarray
    shared: int  # the number that stands for all words outside the model
    bits: int = 20

    def __post_init__(self):
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.slot[(self.word >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(len(self.word))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in ``word``, or -1."""
        out = self.slot[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        if not len(self.word):
            return out
        other = np.flatnonzero((out >= 0) & (self.word[out] != hashes))
        at = np.minimum(np.searchsorted(self.word, hashes[other]), len(self.word) - 1)
        out[other] = np.where(self.word[at] == hashes[other], at, -1)
        return out

    def classes(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.kind[np.maximum(place, 0)], self.shared) if len(self.word) else np.full(len(place), self.shared)


@dataclass
class Classes:
    """Classes of a vocabulary in order of falling counts: ``single`` words alone, then groups, then all words outside."""

    count: np.ndarray
    outside: int  # tokens of all words outside
    single: int = SINGLE

    def __post_init__(self):
        n = len(self.count)
        self.single = min(self.single, n)
        self.first = np.concatenate((np.arange(self.single), np.arange(self.single, n, GROUP), [n]))  # first word of each class
        self.total = np.append(np.add.reduceat(self.count, self.first[:-1]) if n else np.zeros(0), max(self.outside, 1)).astype(float)
        self.sums = np.concatenate(([0.0], np.cumsum(self.count)))

    def of(self, word: np.ndarray) -> np.ndarray:
        """Class of each word; the word ``len(count)`` stands for all outside."""
        last = len(self.first) - 1
        return np.where(word < self.single, word, np.where(word < len(self.count), self.single + (word - self.single) // GROUP, last))


@dataclass
class Parameters:
    """Word vectors ``r`` of predecessors, one matrix ``c`` per place, vectors and biases of classes (``k``, ``a``) and of words (``q``, ``b``)."""

    r: np.ndarray
    c: np.ndarray
    k: np.ndarray
    a: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(classes: Classes, width: int, seed: int) -> Parameters:
        random = np.random.default_rng(seed)
        n = len(classes.count)
        r = random.normal(0, 0.3, (n + 2, width)).astype(np.float32)  # the last two: words outside, and before a text
        k = random.normal(0, 0.05, (len(classes.total), width)).astype(np.float32)
        q = random.normal(0, 0.05, (n, width)).astype(np.float32)
        c = np.stack([np.eye(width), np.eye(width) / 2]).astype(np.float32)
        a = np.log(classes.total / classes.total.sum()).astype(np.float32)
        b = np.log(classes.count / classes.total[classes.of(np.arange(n))]).astype(np.float32)
        return Parameters(r, c, k, a, q, b)

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.c, self.k, self.a, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Parameters(*out)


class Scorer:
    """Normalised log-probabilities of words (for those outside, of their class) after two predecessors."""

    def __init__(self, p: Parameters, classes: Classes):
        self.p, self.classes = p, classes
        self.one, self.two = p.r @ p.c[0], p.r @ p.c[1]

    def log_probability(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, batch: int = 2048) -> np.ndarray:
        out = np.empty(len(word), dtype=np.float32)
        for i in range(0, len(word), PIECE):
            cut = slice(i, i + PIECE)
            out[cut] = self._piece(self.one[one[cut]] + self.two[two[cut]], word[cut], batch)
        return out

    def _piece(self, context: np.ndarray, word: np.ndarray, batch: int) -> np.ndarray:
        p, kind = self.p, self.classes.of(word)
        out = np.empty(len(word), dtype=np.float32)
        for i in range(0, len(word), batch):
            cut = slice(i, i + batch)
            out[cut] = _log_share(context[cut] @ p.k.T + p.a, kind[cut])
        grouped = np.flatnonzero((word >= self.classes.single) & (word < len(self.classes.count)))
        grouped = grouped[np.argsort(kind[grouped], kind="stable")]
        bounds = np.flatnonzero(np.diff(kind[grouped], prepend=-1, append=-1))
        for low, high in zip(bounds[:-1], bounds[1:]):
            at = grouped[low:high]
            first, last = self.classes.first[kind[at[0]] : kind[at[0]] + 2]
            out[at] += _log_share(context[at] @ p.q[first:last].T + p.b[first:last], word[at] - first)
        return out


def _log_share(score: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the share of the chosen column in the sum of exponentials of each row; overwrites the scores."""
    if score.max() > 80:  # exponentials would overflow
        score -= score.max(axis=1)[:, None]
    picked = score[np.arange(len(score)), chosen]
    np.exp(score, out=score)
    return picked - np.log(score.sum(axis=1))


def contexts(kind: np.ndarray, bounds: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the previous token and the one before it; ``before`` stands at the start of a row."""
    one, two = np.full(len(kind), before), np.full(len(kind), before)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    first = bounds[:-1]
    one[first], two[first] = before, before
    second = first + 1
    two[second[second < bounds[1:]]] = before
    return one, two


class Trainer:
    """Noise-contrastive steps with Adagrad.

    Noise classes are shared by the tokens of a minibatch; noise words are drawn for each token from its class.
    """

    def __init__(self, start: Parameters, classes: Classes, seed: int, rate: float = 0.15, batch: int = 2048, noise: int = 32, words: int = 2):
        self.p, self.classes = Parameters(*(a.copy() for a in start.arrays())), classes
        self.squares = [np.full(a.shape, 1e-6, dtype=np.float32) for a in self.p.arrays()]
        share = classes.total / classes.total.sum()
        self.log_noise, self.steps = np.log(share * noise).astype(np.float32), np.cumsum(share)
        within = classes.count / classes.total[classes.of(np.arange(len(classes.count)))]
        self.log_words = np.log(within * words).astype(np.float32)
        self.random, self.rate, self.batch, self.noise, self.words, self.seen = np.random.default_rng(seed), rate, batch, noise, words, 0

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        order = self.random.permutation(len(word))
        for i in range(0, len(word), self.batch):
            some = order[i : i + self.batch]
            self._step(one[some], two[some], word[some])
        self.seen += len(word)

    def _step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        p, n = self.p, len(word)
        r1, r2 = p.r[one], p.r[two]
        context = r1 @ p.c[0] + r2 @ p.c[1]
        kind = self.classes.of(word)
        noise = np.minimum(np.searchsorted(self.steps, self.random.random(self.noise) * self.steps[-1]), len(self.steps) - 1)
        target = p.k[kind]
        up = _miss((context * target).sum(axis=1) + p.a[kind] - self.log_noise[kind])
        down = _miss(-(context @ p.k[noise].T + (p.a[noise] - self.log_noise[noise]))) * np.float32(-1)
        g_context = up[:, None] * target + down @ p.k[noise]
        self._add(2, np.concatenate((kind, noise)), np.concatenate((up[:, None] * context, down.T @ context)), n)
        self._add(3, np.concatenate((kind, noise)), np.concatenate((up, down.sum(axis=0))), n)
        at = np.flatnonzero((word >= self.classes.single) & (word < len(self.classes.count)))
        if len(at):
            own, mine = word[at], context[at]
            low, high = (self.classes.sums[self.classes.first[kind[at] + i]] for i in (0, 1))
            drawn = np.searchsorted(self.classes.sums, low[:, None] + self.random.random((len(at), self.words)) * (high - low)[:, None], "right") - 1
            drawn = np.clip(drawn, self.classes.first[kind[at]][:, None], self.classes.first[kind[at] + 1][:, None] - 1)
            q = p.q[drawn]
            more = _miss((mine * p.q[own]).sum(axis=1) + p.b[own] - self.log_words[own])
            less = _miss(-(np.einsum("nw,nkw->nk", mine, q) + p.b[drawn] - self.log_words[drawn])) * np.float32(-1)
            g_context[at] += more[:, None] * p.q[own] + np.einsum("nk,nkw->nw", less, q)
            words = np.concatenate((own, drawn.ravel()))
            self._add(4, words, np.concatenate((more[:, None] * mine, (less[:, :, None] * mine[:, None, :]).reshape(-1, mine.shape[1]))), n)
            self._add(5, words, np.concatenate((more, less.ravel())), n)
        slope = np.stack([r1.T @ g_context, r2.T @ g_context])
        self._add(0, np.concatenate((one, two)), np.concatenate((g_context @ p.c[0].T, g_context @ p.c[1].T)), n)
        self._add(1, np.arange(2), slope, n)

    def _add(self, which: int, at: np.ndarray, slope: np.ndarray, n: int) -> None:
        """One Adagrad step of the named rows of a parameter; slopes of the same row add up."""
        value, square = self.p.arrays()[which], self.squares[which]
        # 16-bit keys are sorted by radix
        order = np.argsort(at.astype(np.uint16) if len(value) <= 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        slope = np.add.reduceat(slope[order], first, axis=0) / np.float32(n)
        at = at[first]
        square[at] += slope * slope
        value[at] += self.rate * slope / np.sqrt(square[at])


def _miss(score: np.ndarray) -> np.ndarray:
    """One minus the logistic function."""
    return 1 / (1 + np.exp(np.clip(score, -30, 30)))


def _mixed(rows: DataFrame, fan: int = 16) -> np.ndarray | None:
    """Mean of float32 vectors (value binary, weight double) by weight, in a tree of sums."""

    def combined(pairs: Iterator[tuple[bytes, float]]) -> tuple[np.ndarray, float] | None:
        total, weight = None, 0.0
        for value, w in pairs:
            vector = np.frombuffer(value, dtype=np.float32) * np.float64(w)
            total, weight = vector if total is None else total + vector, weight + w
        return None if total is None else ((total / weight).astype(np.float32), weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = combined((v.as_py(), w.as_py()) for batch in batches for v, w in zip(batch["value"], batch["weight"]))
        if mean:
            yield pa.RecordBatch.from_arrays([pa.array([mean[0].tobytes()], pa.binary()), pa.array([mean[1]])], names=["value", "weight"])

    rows = settle(rows)
    left = rows.count()
    while left > 1:
        left = -(-left // fan)
        rows = rows.repartition(left).mapInArrow(run, "value binary, weight double")
    mean = combined(map(tuple, rows.collect()))  # one vector
    return mean[0] if mean else None


@dataclass
class Model:
    head: Head
    classes: Classes
    parameters: Parameters
    train_tokens: int
    distinct: int
    outside_distinct: int


def train(docs: DataFrame, counts: DataFrame, head: int = 250_000, vocabulary: int = 16_384, width: int = 16, rounds: int = 3, seed: int = 3, part: int = 2_000_000) -> Model:
    """Fits the model to all of ``docs``, whose word counts are ``counts``.

    head, vocabulary: most words whose counts and whose vectors go to the tasks.  part: training tokens that one task learns in a round.
    """
    spark = docs.sparkSession
    step = F.floor(F.log2("n") * 8)
    levels = sorted(counts.groupBy(step.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    n, distinct = sum(r[2] for r in levels), sum(r[1] for r in levels)
    least, words_above = None, 0
    for level, number, _ in levels:
        words_above += number
        if words_above > head:
            break
        least = level
    rows = counts.where(step >= least).toPandas() if least is not None else None
    word, count = (rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)) if rows is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(word)
    word, count = word[order], count[order]
    top = np.lexsort((word, -count))[:vocabulary]
    top = top[count[top] >= 3]
    kind = np.full(len(word), len(top), dtype=np.int32)
    kind[top] = np.arange(len(top))
    lookup = Head(word, count, kind, len(top))
    classes = Classes(count[top], int(n) - int(count[top].sum()))
    parameters = Parameters.start(classes, width, seed)
    common = spark.sparkContext.broadcast((lookup, classes))
    for turn in range(rounds if len(top) else 0):
        now = spark.sparkContext.broadcast(parameters)

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            lookup, classes = common.value
            trainer = None
            for batch in batches:
                for block in blocks(batch["text"]):
                    hashes, bounds = tokens(block)
                    kinds = lookup.classes(lookup.find(hashes))
                    trainer = trainer or Trainer(now.value, classes, seed + turn, rate=0.15 / (1 + turn))
                    trainer.learn(*contexts(kinds, bounds, len(classes.count) + 1), kinds)
            if trainer and trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.p.flat().tobytes()], pa.binary()), pa.array([float(trainer.seen)])], names=["value", "weight"])

        some = docs.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(rounds)) == turn).select("text").coalesce(max(1, int(n) // rounds // part))
        mixed = _mixed(some.mapInArrow(learn, "value binary, weight double"))
        if mixed is not None:
            parameters = parameters.filled(mixed)
    return Model(lookup, classes, parameters, int(n), int(distinct), int(distinct - len(top)))


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, outside = Scorer(m.parameters, m.classes), m.head.shared
        log_count = np.log10(m.head.count + 0.5)
        for batch in batches:
            for block in blocks(batch["text"]):
                hashes, bounds = tokens(block)
                place = m.head.find(hashes)
                kind = m.head.classes(place)
                value = scorer.log_probability(*contexts(kind, bounds, outside + 1), kind)
                listed = place >= 0
                known_log = np.where(listed, log_count[np.maximum(place, 0)], 0.0) if len(log_count) else np.zeros(len(kind))
                total = lambda x: np.add.reduceat(x.astype(np.float64), bounds[:-1])
                tail = np.flatnonzero(~listed)
                row = np.searchsorted(bounds, tail, "right") - 1
                order = np.lexsort((hashes[tail], row))
                tail, row = tail[order], row[order]
                word = hashes[tail]
                new = np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1]))) if len(word) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(word)))
                per_row = np.searchsorted(row[first], np.arange(block.rows + 1))
                pairs = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "times"])
                rest = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pairs)
                at = slice(block.first, block.first + block.rows)
                columns = [
                    batch["doc_id"][at],
                    batch["held_out"][at],
                    batch["row_id"][at],
                    pa.array(np.diff(bounds)),
                    pa.array(total(listed).astype(np.int64)),
                    pa.array(total(known_log)),
                    pa.array(total(np.where(kind == outside, known_log, 0))),
                    pa.array(total(kind == outside).astype(np.int64)),
                    pa.array(total(value) / np.log(10)),
                    rest,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row_id long, n_tokens long, n_head long, head_log double, shared_log double, n_shared long, class_log double, rest array<struct<word: bigint, times: int>>"
    rows = settle(docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(run, schema))
    rest = rows.select("row_id", F.explode("rest").alias("t")).select("row_id", "t.word", "t.times")
    rare = rest.join(counts, "word", "left")
    rare = rare.groupBy("row_id").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rest")
    )
    base_mass = float(np.log10(model.train_tokens + 0.5 * (model.distinct + 1)))
    shared_mass = float(np.log10(model.classes.outside + 0.5 * (model.outside_distinct + 1)))
    rest_log, n_rest = F.coalesce("rest_log", F.lit(0.0)), F.coalesce("n_rest", F.lit(0))
    return rows.drop("rest").join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + n_rest).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rest_log - F.col("n_tokens") * base_mass).alias("base_score"),
        (F.col("class_log") + F.col("shared_log") + rest_log - F.col("n_shared") * shared_mass).alias("score"),
    )


_NAMES = ["doc_id", "held_out", "row_id", "n_tokens", "n_head", "head_log", "shared_log", "n_shared", "class_log", "rest"]


def op6_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 1).alias("held_out"), "text")
    learned = docs.where("not held_out").select("text")
    counts = settle(word_counts(learned))
    return score(docs, counts, train(learned, counts))
