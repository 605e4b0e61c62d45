"""Odd inputs of the graph, search, question and canvas operators."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from kgspark.operators import vectors as vectors_module
from kgspark.operators import canvases, gram_index, graph, infer, ingest, phrases, questions, search

VECTOR = "id long, kind string, embedding array<float>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    found = [(i, f"k{i % 3}", rng.normal(size=8 if i % 10 else 5).astype(float).tolist()) for i in range(150)]
    found += [(200, "k0", None), (201, "k0", []), (202, "k1", [0.0] * 8), (203, "k1", found[1][2]), (204, "k1", found[1][2])]
    return spark.createDataFrame(found, VECTOR).repartition(4)


def distance(one, other):
    one, other = np.float32(one).astype(float), np.float32(other).astype(float)
    return 1 - float(one @ other) / (np.linalg.norm(one) * np.linalg.norm(other))


def usable(vectors):
    return [(r["id"], r["kind"], r["embedding"]) for r in vectors.collect() if r["embedding"] and any(r["embedding"])]


@pytest.mark.parametrize("ring", [3, 20, 4096])
def test_nearest_of_unlike_sizes_ties_and_no_queries(spark, vectors, ring):
    found = search.nearest(vectors.where("id % 7 = 0 or id > 190").withColumnRenamed("id", "qid"), vectors, 3, ring=ring, lists=7)
    expected, every = [], usable(vectors)
    for q, _, v in every:
        if q % 7 == 0 or q > 190:
            near = sorted((round(distance(v, w), 9), i) for i, _, w in every if len(w) == len(v))[:3]
            expected += [(q, i, place) for place, (_, i) in enumerate(near, 1)]
    assert rows(found, "qid", "id", "place") == sorted(expected, key=str)
    nothing = vectors.where("id < 0")
    assert search.nearest(nothing.withColumnRenamed("id", "qid"), vectors, 3).count() == 0
    assert search.nearest(vectors.withColumnRenamed("id", "qid"), nothing, 3).count() == 0
    assert search.nearest(vectors.withColumnRenamed("id", "qid"), nothing, 3, exact=False).count() == 0


def clustered(spark, n, centres=12, size=16):
    """Vectors in tight groups of unlike sizes, one of which holds a third of all."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(centres, size))
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centres, n))
    x = middle[own] + 0.05 * rng.normal(size=(n, size))
    return spark.createDataFrame([(i, "k", v.tolist()) for i, v in enumerate(x)], VECTOR).repartition(4), x


def test_pruning_by_angles_loses_nothing_and_compares_few(spark):
    frame, x = clustered(spark, 1500)
    report = Observation()
    found = {r["id"]: r["near"] for r in search.nearest_of_kind(frame, 0.5, ring=50, report=report).collect()}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    distance = 1 - x @ x.T
    distance[np.tril_indices(len(x))] = np.inf
    assert found == {i: int(distance[i].argmin()) for i in range(len(x) - 1) if distance[i].min() < 0.5}
    assert report.get["pairs"] < len(x) ** 2 / 3


def test_many_queries_meet_copies_of_a_ring(spark):
    frame, x = clustered(spark, 600)
    index = vectors_module.build(frame.drop("kind"), ring=64)
    asked = frame.select(F.col("id").alias("qid"), "embedding")
    few, many = (rows(vectors_module.search(index, asked, 3, meet=meet), "qid", "id", "place") for meet in (50, 4096))
    assert few == many and len(many) == 1800
    approximate = rows(vectors_module.search(index, asked, 3, exact=False, first=4), "qid", "id", "place")
    assert len(set(approximate) & set(many)) / len(many) >= 0.9


@pytest.mark.parametrize("ring", [5, 20, 4096])
def test_nearest_of_kind(vectors, ring):
    every = usable(vectors)
    expected = []
    for i, kind, v in every:
        near = [(round(distance(v, w), 9), j) for j, other, w in every if j > i and other == kind and len(w) == len(v)]
        if near and min(near)[0] < 0.5:
            expected.append((i, min(near)[1]))
    assert rows(search.nearest_of_kind(vectors, 0.5, ring), "id", "near") == sorted(expected, key=str)


def test_rows_are_numbered_over_many_tasks(spark):
    rng = random.Random(2)
    values = [("a" if rng.random() < 0.8 else None if rng.random() < 0.5 else "b", i) for i in range(500)]
    found = graph.numbered(spark.createDataFrame(rng.sample(values, 500), "k string, ord int").repartition(7), ["k"], ["ord"], "n")
    expected, seen = [], {}
    for k, i in values:
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, i, seen[k]))
    assert rows(found, "k", "ord", "n") == sorted(expected, key=str)


def test_unique_slugs_skip_what_is_taken(spark):
    names = spark.createDataFrame([("A b", 1), ("a-b ", 2), ("A_B", 3), ("x", 4), ("", 5), (None, 6)], "name string, ord int")
    taken = spark.createDataFrame([("a-b",), ("a-b-2",), ("a-b-4",), ("canvas-2",)], "canvas_id string")
    assert rows(canvases.unique_slugs(names, taken), "ord", "slug") == [(1, "a-b-3"), (2, "a-b-5"), (3, "a-b-6"), (4, "x"), (5, "canvas"), (6, "canvas-3")]


def test_the_last_canvas_stays(spark):
    table = spark.createDataFrame([("a", "A", None, 1, None), ("b", "B", None, 2, None), ("c", "C", None, 3, 9)], "canvas_id string, name string, description string, created long, deleted long")
    asked = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12), ("z", 13)], "canvas_id string, ord long")
    left, told = canvases.trash(table, asked)
    assert rows(told, "canvas_id", "verdict") == [("a", "deleted"), ("b", "last one"), ("c", "unknown"), ("z", "unknown")]
    assert rows(left, "canvas_id", "deleted") == [("a", 10), ("b", None), ("c", 9)]
    kept, (nodes,), told = canvases.purge(left, asked, [spark.createDataFrame([("a", 1), ("b", 2)], "canvas_id string, n int")])
    assert rows(kept, "canvas_id") == [("b",)] and rows(nodes, "canvas_id") == [("b",)]


@pytest.mark.parametrize("part", [4, 1000])
def test_words_are_held_by_texts(spark, part):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(99, None)]
    words = ["a", "ab", "abc", "b c", "cab", "zz", ""]
    found = phrases.held(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([(w,) for w in words], "word string"), part)
    assert rows(found, "i", "word") == sorted(((i, w) for i, t in texts for w in words if w and t and w in t), key=str)


@pytest.mark.parametrize("sent", [5, 20_000])
def test_entities_are_found_either_way(spark, sent):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(names + ["xx"]) for _ in range(6))) for i in range(40)] + [(90, ""), (91, None)]
    vocabulary = spark.createDataFrame([(f"N{i}", n, []) for i, n in enumerate(names)], "id string, label string, synonyms array<string>")
    found = ingest.scan_entities(spark.createDataFrame(texts, "doc int, text string"), vocabulary, part=sent)
    assert rows(found, "doc", "id") == sorted(((d, f"N{i}") for d, t in texts for i, n in enumerate(names) if t and n in t.replace(" ", "")), key=str)


def test_texts_match_conditions_as_a_plain_loop_says(spark):
    rng = random.Random(5)
    texts = [(f"P{i}", i, " ".join(rng.choice(["LED", "slim", "ASIA", "x1", "deep"]) for _ in range(4))) for i in range(50)]
    features = [("f1", "LED", "ASIA", ["slim deep"]), ("f2", "", "", ["x1", "x1 no"]), ("f3", "OLED", "EUROPE", [])]
    frame = spark.createDataFrame(texts, "id string, ord long, text string").selectExpr("'m' as canvas_id", "*")
    found = infer.matched_texts(spark.createDataFrame(features, "fid string, light string, market string, shape array<string>"), frame)
    expected = []
    for fid, light, market, shape in features:
        tokens = [t for s in shape for t in s.split() if len(t) >= 2]
        for i, _, text in texts:
            hits = bool(light and light in text) + bool(market and market in text) + sum(t in text for t in tokens)
            if hits:
                expected.append((fid, i, round(hits / (2 + len(tokens)), 9)))
    assert sorted(((r["fid"], r["id"], round(r["match"], 9)) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_grams_find_what_texts_hold_and_forget_what_changed(spark):
    rng = random.Random(6)
    texts = {(f"N{i}", f): "".join(rng.choice("abA é") for _ in range(rng.randint(0, 12))) for i in range(40) for f in ("label", "sub")}
    terms = ["a", "ab", "aba", "ab a", "bbbb", "é", "zz", "", "a" * 9]
    fields = lambda of: spark.createDataFrame([(i, f, 0, t) for (i, f), t in of.items()] + [("N0", "prop", 1, None)], "id string, field string, part int, t string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = lambda: sorted(((t, i, f) for (i, f), text in texts.items() for t in terms if t and t in text), key=str)
    index = gram_index.build(fields(texts))
    assert rows(index.find(asked), "term", "id", "field") == expected()
    changed = {k: "abab é" for k in texts if k[0] in ("N3", "N4")}
    texts |= changed
    texts = {k: v for k, v in texts.items() if k[0] != "N5"}
    index.refresh(fields(changed), spark.createDataFrame([("N3",), ("N4",), ("N5",), ("N0",)], "id string"))
    texts = {k: v for k, v in texts.items() if k[0] != "N0"}  # changed, and without fields now
    assert rows(index.find(asked), "term", "id", "field") == expected()
