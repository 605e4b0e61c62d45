"""Every operator against a plain version, on odd rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import zstandard
from brute import base_counts, edit_distance, near, normal, personal, repeated_words, split
from pyspark.sql import functions as F

from kgspark.operators import components
from kgspark.llm import boosting, compression, decontamination, jaccard_join, language_model, mixing, pii, quality_rules, sharding, suffix_dedup, token_counts


def ordered(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


# 1 quality rules


def test_quality_base_counts(docs, rows, labels):
    found = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels))
    expected = []
    for r in rows:
        counts = base_counts(r[1])
        expected.append((r[0], *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    assert ordered(found, "doc_id", *quality_rules.BASE, "base_failed") == sorted(expected, key=str)
    assert found.where("base_failed and kept").count() == 0


def test_quality_keeps_columns_and_clashing_names(docs, labels):
    wide = docs.withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "row": F.lit(1.5)})
    kept = quality_rules.filter_documents(wide, labels)
    assert kept.columns == wide.columns
    assert {r["n_words"] for r in kept.collect()} == {"mine"}


def test_quality_without_labels_or_rows(docs, empty, labels):
    assert quality_rules.fit(docs, labels.limit(0)) is None
    assert quality_rules.judge(docs.select("doc_id", "text"), None).where("kept = base_failed").count() == 0
    assert quality_rules.filter_documents(empty, labels).count() == 0


def test_trees_learn_and_keep_directions():
    random = np.random.default_rng(0)
    x = random.random((3000, 3))
    y = (x[:, 0] + 0.3 * random.random(3000) > 0.7).astype(float)
    model = boosting.fit(x, y, np.array([1, -1, 0]))
    assert ((model.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for other in random.random((20, 3)):
        probe = np.repeat(other[None, :], 50, axis=0)
        probe[:, 0] = grid
        assert (np.diff(model.logit(probe)) >= -1e-9).all()
        probe[:, 0], probe[:, 1] = other[0], grid
        assert (np.diff(model.logit(probe)) <= 1e-9).all()


# 2 Jaccard join


def test_jaccard_join_equals_all_pairs(docs, rows):
    links, least = near(rows)
    found = jaccard_join.join(docs)
    assert ordered(found, "doc_id", "class_id", "n_links") == sorted(((r[0], c, n) for r, c, n in zip(rows, least, links)), key=str)


@pytest.mark.parametrize("part", [8, 512])
def test_jaccard_join_of_a_large_group(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard_join, "PART", part)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        for k in range(i % 5):
            own[(37 * i + 23 * k) % 120] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    links, least = near(rows)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(found, "doc_id", "class_id", "n_links") == sorted(((r[0], c, n) for r, c, n in zip(rows, least, links)), key=str)


def test_one_of_each_group(docs, rows, empty):
    _, least = near(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {("null", r[1]) if c is None else c for r, c in zip(rows, least)}
    assert kept.count() == len(groups)
    assert jaccard_join.one_of_each(empty).count() == 0
    assert jaccard_join.join(empty).count() == 0


def test_measured_depth_reaches_the_target(spark):
    sizes = spark.createDataFrame([(bytes([i % 256, i // 256]), 20 + 3 * i) for i in range(300)], "key binary, grams long")
    loose, tight = (jaccard_join.measured_depth(sizes, 0.8, target) for target in (0.9, 0.999))
    assert 1 <= tight <= loose <= jaccard_join.DEPTH
    assert jaccard_join.measured_depth(sizes.select("key", F.lit(2).cast("long").alias("grams")), 0.8, 0.999) == jaccard_join.DEPTH
    random, met = np.random.default_rng(11), 0
    for _ in range(3000):  # pairs with a similarity of exactly 0.8
        grams = random.integers(0, 1 << 63, 100, dtype=np.uint64)
        one, other = jaccard_join.minima(grams[:90]), jaccard_join.minima(grams[10:])
        met += jaccard_join.shared_prefix(one[None], other[None]).max() >= tight
    assert met / 3000 >= 0.998


def test_least_similar_sets():
    for size in range(1, 200):
        taken, added = jaccard_join.least_similar(size, 0.8)
        assert 0.8 - 1e-9 <= (size - taken) / (size + added) <= 1 and (taken + added > 0) == (size >= 4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


# 3 decontamination


def planted(spark):
    items = [(i, " ".join(f"Item{i}word{k}," for k in range(n))) for i, n in enumerate((4, 12, 30, 31, 60))]
    docs = []
    for i, text in items:
        words = text.split()
        edits = int(0.2 * len(words) + 1e-9)
        for e in (0, edits, edits + 2):
            changed = list(words)
            for k in range(e):
                at = (7 * k + 3) % len(changed)
                if k % 3 == 0:
                    changed[at] = f"other{k}"
                elif k % 3 == 1:
                    changed.insert(at, f"more{k}")
                else:
                    del changed[at]
            docs.append((100 * i + e, " ".join([f"a{k}" for k in range(20)] + changed + [f"b{k}" for k in range(15)])))
    docs += [(9000, None), (9001, ""), (9002, "Item0word0"), (0, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), docs, spark.createDataFrame([*items, (50, None), (51, ""), (52, "...")], "item_id int, text string"), items


def test_decontamination_equals_edit_distances(spark):
    frame, docs, benchmark, items = planted(spark)
    expected = []
    for d, text in docs:
        for i, item in items:
            distance = edit_distance(normal(item), normal(text))
            if distance <= int(0.2 * len(normal(item)) + 1e-9):
                expected.append((d, i, distance))
    found = decontamination.matches(frame, benchmark)
    assert ordered(found, "doc_id", "item_id", "distance") == sorted(expected, key=str)
    spans = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    texts = dict(docs)
    for (d, i), r in spans.items():
        stretch = normal(texts[d])[r["first_word"] : r["end_word"]]
        assert edit_distance(normal(dict(items)[i]), stretch) == r["distance"]


def edited(random, words, edits):
    """``words`` with so many random edits."""
    out = list(words)
    for k in range(edits):
        at, kind = int(random.integers(0, len(out))), int(random.integers(0, 3))
        out[at : at + (kind != 0)] = [] if kind == 1 else [f"other{k}"]
    return out


@pytest.mark.parametrize("n", [20, 80, 200, 1000])
def test_decontamination_reaches_its_target_inside_other_text(n):
    prepared = decontamination.Benchmark([(i, " ".join(f"i{i}w{k}" for k in range(n))) for i in range(10)], 0.8, 0.99)
    c, random = prepared.classes[0], np.random.default_rng(1)
    source = random.integers(0, len(c.codes), 1000)
    lists = [edited(random, c.codes[i].tolist(), int(c.edits[i])) for i in source]
    lists = [np.array([prepared.other if isinstance(w, str) else w for w in t] + [prepared.other] * 2 * n, dtype=np.int32) for t in lists]
    found = np.full(len(source), c.repeats == 0)
    for a, b in zip(prepared._keys(c, *prepared._joined(lists), c.repeats), prepared._keys(c, *prepared._joined([c.codes[i] for i in source]), c.repeats)):
        found |= a == b
    assert found.mean() >= 0.985


@pytest.mark.parametrize("most", [24, 0])
def test_decontamination_of_long_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "_MOST_REPEATS", most)
    random = np.random.default_rng(2)
    items = [(n, " ".join(f"i{n}w{k % (n - 7)}" for k in range(n))) for n in (10, 200, 500, 1000)]
    docs = [(10 * n + j, " ".join([f"a{k}" for k in range(30)] + edited(random, text.split(), n // 5) + [f"b{k}" for k in range(30)])) for n, text in items for j in range(3)]
    found = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    texts = dict(docs)
    rows = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    assert set(rows) == {(10 * n + j, n) for n, _ in items for j in range(3)}
    assert all(d == edit_distance(normal(dict(items)[i]), normal(texts[doc])) for (doc, i), d in rows.items() if i <= 200)


def test_clean_documents(spark, empty):
    frame, docs, benchmark, _ = planted(spark)
    wide = frame.withColumns({"row": F.lit(1), "item_id": F.lit("mine")})
    dirty = {r["doc_id"] for r in decontamination.matches(frame, benchmark).collect()}
    clean = decontamination.clean_documents(wide, benchmark, block_items=2)
    assert clean.columns == wide.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - dirty
    assert decontamination.clean_documents(empty, benchmark).count() == 0
    assert decontamination.clean_documents(frame, benchmark.limit(0)).count() == len(docs)
    assert decontamination.matches(frame, benchmark.limit(0)).count() == 0


# 4 sharding and 10 mixing


def test_sharding_law_and_slots(docs, rows):
    found = sharding.shard(docs, shards=5).toPandas()
    assert len(found) == len(rows)
    expected = sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(zip(found["size"], found["text_crc32"])) == expected
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    # no group is as large as a shard here but the longest text, which is one row
    together = found.merge(pd.DataFrame({"crc": [zlib.crc32((r[1] or "").encode()) for r in rows]}).drop_duplicates(), left_on="text_crc32", right_on="crc")
    assert (together.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    assert list(found.columns[:7]) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_packing_equals_a_plain_loop():
    random = np.random.default_rng(4)
    for n in (1, 7, 90):
        items = random.integers(1, 100, (n, 3)) / 50
        share = items / items.sum(axis=0)
        left, expected = [[1 / 6] * 3 for _ in range(6)], {}
        for i in sorted(range(n), key=lambda i: (-max(share[i]), i)):
            with_room = [s for s in range(6) if left[s][0] >= share[i][0]]
            fit = lambda s, i=i: sum(a * b for a, b in zip(left[s], share[i]))
            expected[i] = max(with_room, key=lambda s: (round(fit(s), 12), -s)) if with_room else max(range(6), key=lambda s: (left[s][0], -s))
            left[expected[i]] = [a - b for a, b in zip(left[expected[i]], share[i])]
        assert sharding.fill(share, 6).tolist() == [expected[i] for i in range(n)]
        before, after = (np.bincount(c, items[:, 0], 6) for c in (sharding.fill(share, 6), sharding.pack(items, 6)))
        assert np.ptp(after) <= np.ptp(before)


def test_sharding_splits_a_hot_group(spark, empty):
    rows = [(i, "same text of some length " * 4) for i in range(3000)] + [(i, f"text {i} " * (i % 40)) for i in range(3000, 6000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    size = found.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.01 * size.mean()
    assert sharding.shard(empty).count() == 0


def test_mixing_targets(docs, rows, empty):
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.capped_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))))
    for name, part in found.groupby("source", dropna=False):
        name = None if pd.isna(name) else name
        assert part["source_size"].iloc[0] == sizes[name]
        assert math.isclose(part["target"].iloc[0], target[name])
        assert abs(part["taken"].sum() - target[name]) <= max(2, 0.02 * target[name])
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert Counter(map(tuple, found[["text_key", "taken"]].to_numpy())) == Counter(map(tuple, again[["text_key", "taken"]].to_numpy()))
    assert mixing.mix(empty).count() == 0


def test_capped_targets():

    target = mixing.capped_targets([10, 1000, 1000], [5, 2, 1], 1500)
    assert target[0] == 20 and math.isclose(target.sum(), 1500) and (target <= [20, 2000, 2000]).all()


def test_sainte_lague_equals_one_seat_at_a_time():
    random = np.random.default_rng(1)
    for _ in range(50):
        weights, caps = random.integers(0, 50, 6).astype(float), random.integers(0, 9, 6)
        seats, out = int(random.integers(0, 40)), np.zeros(6, int)
        for _ in range(seats):
            quotient = np.where((out < caps) & (weights > 0), weights / (2 * out + 1), -1)
            if quotient.max() <= 0:
                break
            out[quotient.argmax()] += 1
        assert mixing.sainte_lague(weights, caps, seats).tolist() == out.tolist()


# 5 token counts


def test_rollup_is_idempotent(spark, tmp_path):
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit(0, batch(("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", None, None, "t", None, None)))
    change = batch(("revise", "a", "en", "t", 7, 10), ("delete", "a", "en", "t", 5, None))
    rollup.commit(1, change)
    rollup.commit(1, change)
    rollup.commit(2, batch(("insert", "b", "de", "t", 3, None), ("delete", "b", "de", "t", 3, None)))
    rollup.commit(3, batch())
    assert ordered(rollup.totals(), "source", "lang", "tokenizer", "documents", "tokens") == [("a", "en", "t", 1, 7), (None, None, "t", 1, 0)]
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit(4, batch(("upsert", "a", "en", "t", 1, None)))
    assert rollup.totals().count() == 2  # a commit that failed changes nothing
    rollup.commit(1, batch(("delete", "a", "en", "t", 10, None)))  # another content under the same id takes its place
    assert ordered(rollup.totals(), "source", "lang", "tokenizer", "documents", "tokens") == [("a", "en", "t", 1, 5), (None, None, "t", 1, 0)]


def test_rollup_does_not_take_a_broken_log_for_an_empty_one(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "broken"))
    change = spark.createDataFrame([("insert", "a", "en", "words-1", 5, 0)], "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    rollup.commit(0, change)
    for file in (tmp_path / "broken" / "log").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        rollup.commit(1, change)
    with pytest.raises(Exception):
        rollup.totals().collect()


def test_rollup_of_no_documents(spark, tmp_path, empty):
    rollup = token_counts.Rollup(spark, str(tmp_path / "none"))
    counted = token_counts.counted(empty).select(F.lit("insert").alias("kind"), "source", "lang", "tokenizer", "tokens", F.lit(0).cast("long").alias("old_tokens"))
    rollup.commit(0, counted)
    assert rollup.totals().count() == 0


def test_rollup_as_streaming_sink(spark, tmp_path, docs):
    counted = token_counts.counted(docs).select(F.lit("insert").alias("kind"), "source", "lang", "tokenizer", "tokens", F.lit(0).cast("long").alias("old_tokens"))
    counted.repartition(3).write.parquet(str(tmp_path / "in"))
    rollup = token_counts.Rollup(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(counted.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(rollup.for_each_batch()).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    total = counted.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    assert ordered(rollup.totals(), "source", "lang", "tokenizer", "documents", "tokens") == ordered(total, "source", "lang", "tokenizer", "documents", "tokens")


# 6 language model


def scored(docs):
    rows = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"), "text")
    learned = rows.where("not held_out").select("text")
    counts = language_model.word_counts(learned)
    return language_model.score(rows, counts, language_model.train(learned, counts, head=50))


def test_language_model_base_scores(docs, rows, empty):
    tokens = [[re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in split(r[1])] + [None] for r in rows]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 1 for r in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    expected = sorted(
        ((r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t, h in zip(rows, tokens, held)), key=str
    )
    found = scored(docs).withColumn("base", F.round("base_score", 6))
    assert ordered(found, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base") == expected
    assert found.where("score is null or score > 0 or isnan(score)").count() == 0
    assert scored(empty).count() == 0


def test_language_model_is_normalised_and_learns_order(monkeypatch):
    monkeypatch.setattr(language_model, "GROUP", 3)
    monkeypatch.setattr(language_model, "PIECE", 50)
    random = np.random.default_rng(0)
    word = np.zeros(60000, dtype=np.int64)
    for i in range(1, len(word)):
        word[i] = (word[i - 1] + 1) % 11 if random.random() < 0.9 else random.integers(0, 11)
    classes = language_model.Classes(np.bincount(word, minlength=11)[:10], int((word == 10).sum()), 2)  # the last word is outside
    assert classes.of(np.arange(11)).tolist() == [0, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5]
    trainer = language_model.Trainer(language_model.Parameters.start(classes, 8, 0), classes, 0)
    one, two = language_model.contexts(word, np.array([0, len(word)]), 11)
    for _ in range(4):
        trainer.learn(one, two, word)
    scorer = language_model.Scorer(trainer.p, classes)
    every = np.stack([scorer.log_probability(one[:400], two[:400], np.full(400, w)) for w in range(11)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-3)
    p, context = trainer.p, trainer.p.r[one[7]] @ trainer.p.c[0] + trainer.p.r[two[7]] @ trainer.p.c[1]
    share = lambda x, i: math.log(math.exp(x[i]) / sum(map(math.exp, x)))
    plain = share([float(context @ v + a) for v, a in zip(p.k, p.a)], 3) + share([float(context @ p.q[w] + p.b[w]) for w in (5, 6, 7)], 1)
    assert math.isclose(every[6, 7], plain, abs_tol=1e-3)
    assert scorer.log_probability(one, two, word).mean() > math.log(1 / 11) + 0.8


def test_language_model_tells_held_out_text_better_than_counts(spark):
    random, words = np.random.default_rng(3), [f"w{i}" for i in range(40)]
    texts = []
    for i in range(300):
        at, text = int(random.integers(0, 40)), []
        for _ in range(200):
            text.append(words[at])
            at = (at + 1) % 40 if random.random() < 0.8 else int(random.integers(0, 40))
        texts.append((i, " ".join(text)))
    found = scored(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.9 * found[1]


# 7 personal data


def test_personal_data_base_spans(spark, docs, rows):
    texts = [
        "a@b.com_x@y.z 1.2.3.4.5.6 300.1.1.1 001.2.3.4 +1 (325) 555-8094 4111 1111 1111 1111 😀 é x.y@z.co +123",
        "@@@ a@b c@d. e@f.g. " + "9" * 300 + " " + "a" * 4000 + "@ " + "1234567890123456 " * 700,
        "12 34 5678.1.2.3 +49 30 1234567890123456789 1" + "-1" * 20 + " joe (at) site (dot) com call (212) 555-1234",
    ]
    more = [(5000 + i, t) for i, t in enumerate(texts)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = pii.digest(pii.detect(frame))
    expected = []
    for r in [*rows, *more]:
        spans = personal(r[1])
        count = Counter(s.split(":")[0] for s in spans)
        expected.append((r[0], count["email"], count["ip"], count["card"], count["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert ordered(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=str)
    for r in found.join(frame.select("doc_id", "text"), "doc_id").collect():
        assert set(personal(r["text"])) <= set(filter(None, r["spans"].split(",")))


def test_personal_data_added_spans(spark):
    """Proposed spans that the labelers favour are added, those they speak against are not, and none overlaps another."""
    rows, at = [], {}
    for i in range(120):
        rows.append((i, f"contact anna by e-mail x{i}@mail.com or call +49 30 555{i:05d} now, host 81.2.69.{i}"))
    for i in range(120, 160):
        text = f"write to e-mail joe{i} (at) site (dot) com and call (212) 555-{i:04d} please"
        at[i] = {(text.index("joe"), 0, text.index(" and call")), (text.index("(212)"), 3, text.index(" please"))}
        rows.append((i, text))
    for i in range(160, 200):
        rows.append((i, f"order version 111 222 {i:04d}x serial v 000.111.{2000 + i}y"))
    for i in range(200, 260):
        rows.append((i, f"the sum of {4539148803430000 + i} and 40123{i}7{i} is large, and so is 5105105105105{i}"))
    found = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({tuple(s) for s in found[i]["added"]} == spans for i, spans in at.items())
    assert all(not found[i]["added"] for i in range(160, 260))


def test_bare_numbers_that_fail_the_check_digit_add_nothing(spark):
    """Cards that pass are base spans; like numbers that fail are not added, however many there are and whatever issuer they begin with."""
    good, bad = [], []
    for i in range(4000):
        text = f"{4000000000000000 + 37 * i}" if i % 2 else f"5{105105105105000 + 41 * i}"
        (good if personal(text) else bad).append(text)
    for share in (1, 20):
        rows = [(i, f"paid {t} then") for i, t in enumerate(good[:200] + bad[: 200 * share])]
        found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(len(r["base"]) for r in found) == 200 and not any(r["added"] for r in found)


def test_personal_data_overlaps(spark):
    random = np.random.default_rng(6)
    rows = []
    for i in range(200):
        cut = np.sort(random.choice(200, 12, replace=False)).reshape(-1, 2)
        more = [(int(a), int(random.integers(0, 4)), int(a + random.integers(1, 30))) for a in random.integers(0, 200, 9)]
        rows.append((i, [(int(a), 0, int(b)) for a, b in cut], list({m[0]: m for m in more}.values())))
    spans = "array<struct<start: int, kind: int, end: int>>"
    found = {r["row_id"]: [tuple(s) for s in r["added"]] for r in pii._without_overlaps(spark.createDataFrame(rows, f"row_id long, base {spans}, more {spans}")).collect()}
    for i, base, more in rows:
        free = [m for m in sorted(more) if all(m[0] >= b[2] or b[0] >= m[2] for b in base)]
        assert found.get(i, []) == [m for n, m in enumerate(free) if all(o[2] <= m[0] for o in free[:n])]


def test_personal_data_without_rows(empty):
    assert pii.digest(pii.detect(empty)).count() == 0


def test_reliabilities_find_the_good_labelers():
    random = np.random.default_rng(0)
    counted = Counter()
    for i in range(6000):
        base = i < 2000
        real = base or random.random() < 0.3
        counted[tuple(int((1 if real else -1) * (1 if random.random() < p else -1)) for p in (0.95, 0.9, 0.6)), base] += 1
    patterns = [(v, base, float(n)) for (v, base), n in sorted(counted.items())]
    rate, prior, posterior = pii.reliabilities(patterns)
    assert rate[0][0] > rate[2][0] and rate[1][0] > rate[2][0] and abs(prior - 0.3) < 0.1
    assert all(p == 1 for p, (_, base, _) in zip(posterior, patterns) if base)
    weight = pii.span_classifier([(v, n) for v, _, n in patterns], posterior)
    assert weight[1] > weight[3] and weight[2] > weight[3]


# 8 compression classifier


def test_compression_classifier(docs, rows, labels, empty, spark):
    good = [(i, " ".join(f"plain{(i * k) % 17} words" for k in range(60))) for i in range(400)]
    bad = [(1000 + i, " ".join(f"zz{(i * k) % 19}### $$" for k in range(60))) for i in range(400)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    found = compression.score(frame, compression.fit(frame, marks)).toPandas()
    held = found[found["held_out"]]
    assert len(held) > 100 and ((held["doc_id"] < 1000) == (held["predicted"] == 1)).mean() > 0.95
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in held["doc_id"])
    odd = compression.score(docs, compression.fit(docs, labels)).toPandas()
    assert len(odd) == len(rows) and odd["score"].between(0, 1).all() and ((odd["score"] >= 0.7) == (odd["predicted"] == 1)).all()
    assert compression.score(docs, compression.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert compression.score(empty, compression.fit(empty, labels)).count() == 0


def test_compression_scores_equal_a_plain_version(spark):
    random = np.random.default_rng(12)
    texts = [(i, " ".join(("w" if i % 3 else "v") + str(k) for k in random.integers(0, 900, int(random.integers(1, 6000))))) for i in range(120)] + [(500, ""), (501, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = compression.fit(frame, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int"))
    own = {i: (t or "").encode() for i, t in texts}
    for mark, pieces in ((1, model.good), (0, model.bad)):
        assert all(any(piece in own[i] for i in range(120) if (i % 3 > 0) == mark) for piece in pieces.split(b"\n"))
    packers = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in compression.score(frame, model).collect():
        text, sizes = own[r["doc_id"]], []
        for packer in packers:
            sizes.append(sum(len(packer.compress(text[i : i + compression.PIECE])) for i in range(0, len(text), compression.PIECE)))
        x = [(sizes[1] - sizes[0]) / (sizes[0] + sizes[1]), math.log(sum(sizes) / 2 / len(text) + 1e-3), math.log1p(len(text))] if text else [0.0, 0.0, 0.0]
        a, b, c = ((v - m) / s for v, m, s in zip(x, model.center, model.scale))
        logit = sum(w * v for w, v in zip(model.weight, (1, a, b, c, a * b, b * b, a * c, c * c)))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, logit)))), abs_tol=1e-9)


def test_compression_classifier_learns_from_whole_texts(spark):
    random = np.random.default_rng(5)
    vocabulary, rows = ["".join(random.choice(list("abcdefghij"), 8)) for _ in range(1000)], []
    for i in range(60):
        text = " ".join(random.choice(vocabulary, 3000))
        rows += [(i, "same start " * 5000 + text), (1000 + i, "same start " * 5000 + text.translate(str.maketrans("abcdefghij", "klmnopqrst")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(d, int(d < 1000)) for d, _ in rows], "doc_id long, quality int")
    found = compression.score(frame, compression.fit(frame, marks)).where("held_out").toPandas()
    assert len(found) > 15 and found.loc[found["doc_id"] < 1000, "score"].min() > found.loc[found["doc_id"] >= 1000, "score"].max()


# 9 repeated passages


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_repeated_passages(docs, rows, empty, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    expected = []
    for r, marked in zip(rows, repeated_words(rows)):
        flat = [False, *marked, False]
        starts = [i for i in range(len(marked)) if flat[i + 1] and not flat[i]]
        ends = [i for i in range(1, len(marked) + 1) if flat[i] and not flat[i + 1]]
        expected.append((r[0], sum(marked), ",".join(f"{a}:{b}" for a, b in zip(starts, ends))))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = suffix_dedup.repeated_spans(docs).withColumn("listed", listed)
    assert ordered(found, "doc_id", "n_repeated", "listed") == sorted(expected, key=str)
    assert found.where("n_repeated > 0").count() >= 8
    assert suffix_dedup.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_repeated_passages_with_varied_borders(spark, monkeypatch, chunk):
    """A passage whose parts stand in many texts, each part in other company, so that neighbours alone would miss some."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    random, passage = np.random.default_rng(8), [f"p{i}" for i in range(110)]
    rows = []
    for i in range(60):
        a = int(random.integers(0, 55))
        b = a + int(random.integers(45, 56))
        rows.append((i, " ".join([f"l{i}_{k % 9}" for k in range(int(random.integers(0, 70)))] + passage[a:b] + [f"r{i}_{k}" for k in range(int(random.integers(0, 40)))])))
    rows += [(100, "same " * 300), (101, "same " * 90 + "other"), (102, "same " * 49)]
    expected = sorted((r[0], sum(m)) for r, m in zip(rows, repeated_words(rows)))
    found = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r["doc_id"], r["n_repeated"]) for r in found.collect()) == expected
