"""Importance resampling, toxicity behind disguises, and spelling variants against plain versions, on odd rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose_words
from pyspark.sql import functions as F

from kgspark.llm import deobfuscation, resampling, spelling, toxicity

CLASHING = "word n key row part place score weight rank cells fit size held_out toxic bucket start run form root a b a_n b_n".split()


@pytest.fixture(scope="module")
def wide(docs):
    """The odd rows with extra columns, whose names the operators use themselves."""
    return docs.withColumns({name: F.lit("mine") for name in CLASHING})


# 11 importance resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def runs(text, longest=1):
    words = WORDS.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def resampled(rows, target, longest=1, buckets=10_000, share=(10, 100), least=20):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(code, runs(r[1], longest)[0]))
    for text in target:
        t.update(map(code, runs(text, longest)[0]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r in rows:
        found, n = runs(r[1], longest)
        weight = sum(gain(code(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * share[0] // share[1]])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


TARGET = ["ta re mo lin " * 10, "Moé sha\nver", "", None]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 200), (2, 70_000)])
def test_resampling_equals_a_plain_version(spark, wide, rows, longest, buckets):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    found = resampling.resample(wide, target, share=(40, 100), longest=longest, buckets=buckets).collect()
    expected = resampled(rows, TARGET, longest, buckets, (40, 100))
    assert sorted(map(str, ((*r[:4],) for r in expected))) == sorted(map(str, ((*r[:4],) for r in found)))
    ranked = lambda every: sorted((r[4], r[0], r[3]) for r in every if r[4])
    assert ranked(found) == ranked(expected)


def test_resampling_of_nothing(spark, docs, empty):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, nothing).count() == 0
    assert resampling.resample(docs, nothing).count() == docs.count()


def test_words_stand_where_their_offsets_say():
    split = resampling.splitter()
    text = "It's\nÉté 4U, \U0001f600x\n\nEND"
    words, offsets = resampling.words_with_offsets(split, text)
    assert words == WORDS.findall(lowered(text)) == [lowered(text[a:b]) for a, b in offsets]
    assert [lowered(text[a:b]) for _, _, (a, b) in resampling.windows(offsets, 2)][len(words)] == "it's"


def test_ranks_are_those_of_a_sort_over_many_tasks(spark):
    rows = [(i, " ".join(prose_words(i % 50, 25))) for i in range(400)] + [(None, "ta re")] * 5 + [(7, " ".join(prose_words(7, 25)))] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resampling.resample(frame, spark.createDataFrame([("ta re mo",)], "text string"), share=(1, 2))
    expected = resampled(rows, ["ta re mo"], share=(1, 2))
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in found.where("rank is not null").collect()) == sorted((r[4], r[0], r[3]) for r in expected if r[4])


# 12 toxicity


@pytest.fixture(scope="module")
def characters():
    text = " ".join(prose_words(1, 4000)) + " idiot stupid moron the you online trash" * 60
    counts = np.zeros((deobfuscation.N,) * 3, dtype=np.int64)
    for word in text.split():
        s = [0, 0, *(deobfuscation.NUMBER[c] for c in word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    return counts


def test_trigrams_are_counted_as_a_loop_does(spark, characters):
    texts = [" ".join(prose_words(1, 50)), "ABC Éà, x--y", "", None, "1d10t"]
    found = deobfuscation.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    expected = Counter()
    for text in texts:
        for word in re.split(r"[^a-zà-ÿ]+", (text or "").lower()):
            s = [0, 0, *(deobfuscation.NUMBER[c] for c in word), 0]
            if word:
                expected.update(zip(s, s[1:], s[2:]))
    assert {tuple(map(int, k)): int(found[tuple(k)]) for k in np.argwhere(found)} == dict(expected)


def best_path(units, table):
    """The dearest way through a lattice by trying all."""
    ways = [((0, 0), 0.0, ())]
    for options in units:
        following = []
        for (a, b), score, symbols in ways:
            for chosen, cost in options:
                x, y, total = a, b, score + cost
                for c in chosen:
                    total += table[0 if y == 0 else x, y, c]
                    x, y = y, c
                following.append(((x, y), total, symbols + chosen))
        ways = following
    return max(score + table[0 if b == 0 else a, b, 0] for (a, b), score, _ in ways)


def test_viterbi_finds_the_best_of_all_ways(characters):
    model = deobfuscation.characters(characters)
    tokens = ["1d10t", "$tuuuupid!!", "m0r0n", "a", "!!", "b2b", "tra$h$$$", "on1ine", "x-4y"]
    lattices = [deobfuscation.lattice(t) for t in tokens] + [deobfuscation.apart_lattice(t) for t in ("t h e", "y o u  1 d", "m.o.r")]
    chosen = deobfuscation.decode(lattices, model)
    for units, text in zip(lattices, chosen):
        symbols = deobfuscation._viterbi([units], len(units), max(map(len, units)), model.table)[0]
        assert " ".join("".join(deobfuscation.LETTERS[s - 1] if s else " " for s in symbols).split()) == text
        scores = []
        ways = [((), 0.0)]
        for options in units:
            ways = [(s + o, c + cost) for s, c in ways for o, cost in options]
        for s, cost in ways:
            if list(s) == symbols:
                x, y, total = 0, 0, cost
                for c in [*s, 0]:
                    total += model.table[0 if y == 0 else x, y, c]
                    x, y = y, c
                scores.append(total)
        assert max(scores) == pytest.approx(best_path(units, model.table), abs=1e-4)


def test_disguised_words_are_restored_and_others_left_alone(characters):
    restorer = toxicity.Restorer(deobfuscation.characters(characters))
    shown = {
        "You 1d10t!": "you idiot!", "s t u p i d": "stupid", "m.o.r.o.n": "moron", "$tuuuupid": "stupid", "TRA$H": "trash", "plain words, 12 3.": "plain words, 12 3.", "": "", "on1ine": "online",
    }
    assert [t.replace("!", "") for t in restorer.restore(list(shown))] == [t.replace("!", "") for t in shown.values()]
    assert restorer.restore(list(shown)) == restorer.restore(list(shown))


def test_no_trace_is_passed_over():
    texts = ["", "a b c", "x1", "1 a", "aaa", "ab", "a.b.c d", "word$", "10 20 30", "ééé", "café 1a", "a  b  c", "(a b c)", "一 1", "ta re " * 50 + "i d i o t"]
    traced, apart = deobfuscation.traced(texts)
    assert [bool(deobfuscation.TRACE.search(t)) for t in texts] == traced.tolist()
    assert all(f for t, f in zip(texts, apart) if deobfuscation.APART.search(t))


@pytest.fixture(scope="module")
def insults():
    rows = []
    for i in range(300):
        words = prose_words(1000 + i, 40)
        if i % 3 == 0:
            words[5], words[20] = "idiot", ["moron", "m0r0n", "stupid", "s t u p i d"][i % 4]
        rows.append((i, " ".join(words), i % 3 == 0))
    return rows


def test_toxic_texts_are_told_apart_when_disguised(spark, insults):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in insults], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(found[i]["predicted"] == y for i, _, y in insults)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you 1d10t and m0r0n"), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    rows = sorted(toxicity.score(odd, model).collect(), key=str)
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["doc_id"] for r in rows if r["predicted"]} == {None}
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1


def test_toxicity_without_marks_or_rows(docs, empty, labels):
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    clean = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, clean).collect())
    assert toxicity.score(empty, clean).count() == 0
    assert toxicity.fit(empty, labels).weight == {}


def test_labels_held_out_teach_nothing(spark, insults):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id long, text string")
    right = spark.createDataFrame([(i, int(y)) for i, _, y in insults], "doc_id long, toxic int")
    held = [(i, 1 - int(y) if zlib.crc32(str(i).encode()) % 5 == 0 else int(y)) for i, _, y in insults]
    wrong = spark.createDataFrame(held, "doc_id long, toxic int")
    assert toxicity.fit(docs, right).weight == toxicity.fit(docs, wrong).weight


def test_near_copies_are_one_witness(spark):
    base = prose_words(5, 300)
    copies = [(" ".join(base[:k] + ["other"] + base[k + 1 :]), 1.0) for k in range(0, 300, 12)] + [(" ".join(prose_words(6, 50)), 0.0), (None, 0.0), ("", 0.0)]
    assert toxicity.apart(spark.createDataFrame(copies, "text string, toxic double")).count() <= 8


# 13 spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(count):
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_apart(a, b):
                near[a].append(b)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in near}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near.get(w, ())), words[form[w]] if w in form else None) for w, n in words.items())


def test_variants_equal_all_pairs(spark):
    random = np.random.default_rng(3)
    count = Counter()
    for _ in range(700):
        word = "".join(random.choice(list("abcé"), random.integers(4, 9)))
        count[word] += int(random.integers(1, 40))
    frame = spark.createDataFrame(sorted(count.items()), "word string, n long").where("length(word) >= 5 and n >= 3")
    for parts in (3, 4, 6):
        pairs = spelling.near_pairs(frame, parts).collect()
        assert len(pairs) == len({(r["a"], r["b"]) for r in pairs})
        assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a in count for b in count if a < b and len(a) >= 5 <= len(b) and count[a] >= 3 <= count[b] and one_apart(a, b)}
    found = spelling.group_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, found)) == variants(count)


def test_forms_are_followed_to_the_last(spark):
    words = [("abcde" + "x" * i, 3 * 2**i) for i in range(20)]
    found = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(found.values()) == {words[-1][0]}


def test_mistyped_words_of_odd_rows(spark, wide, rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    found = spelling.runs(wide).select(spelling.mistyped(F.col("doc_id"), F.col("run")).alias("word"))
    known = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert known == dict(count)
    table = spelling.vocabulary(found)
    result = spelling.group_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, result)) == variants(count)


def test_variants_of_nothing(empty):
    found = spelling.runs(empty).select(F.col("run").alias("word"))
    assert spelling.group_variants(spelling.vocabulary(found)).count() == 0
