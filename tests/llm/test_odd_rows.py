"""All ten operators on a text above a megabyte, ties, repeated rows and extra columns whose names they use themselves."""

import zlib

import pytest
from brute import base_counts, normal, personal, prose_words, split
from pyspark.sql import functions as F

from kgspark.llm import compression, decontamination, jaccard_join, language_model, mixing, pii, quality_rules, sharding, suffix_dedup, token_counts
from kgspark.llm.wordhash import BLOCK_BYTES

CLASHING = (
    "key row signature grams depth text_id place spans head left right shard slot unit like size tokens cell turn rank taken target base more row_id "
    "kind word n held_out score quality toxic mark good measured item_id distance found copies n_words kept base_failed own id"
).split()
ITEM = " ".join(f"item{i}" for i in range(40))
PASSAGE = " ".join(f"passage{i}" for i in range(70))


@pytest.fixture(scope="module")
def rows():
    long = prose_words(1, 220_000)
    near = list(long)
    near[1000:1010] = ["another"] * 10
    tail = " " + PASSAGE + " " + ITEM + " x.y@example.com +1 (212) 555-0199"
    texts = [" ".join(long) + tail, " ".join(near) + tail, " ".join(prose_words(2, 80)) + " apart " + PASSAGE, " ".join(prose_words(3, 120)), " ".join(prose_words(3, 120)), None, ""]
    out = [(i, t, "en", "a" if i % 2 else "b", 1) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[3], None, None, None)]


@pytest.fixture(scope="module")
def wide(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({name: F.lit("mine") for name in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, 0, "theirs", "theirs") for i in range(6)] + [(2, 1, 0, "", "")], "doc_id long, quality int, toxic int, text string, key string")


def by_id(frame, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in frame.select("doc_id", *columns).collect()), key=str)


def test_long_text_crosses_a_block(rows):
    assert len(rows[0][1].encode()) > BLOCK_BYTES


def test_quality(wide, rows, marks):
    found = quality_rules.judge(wide.select("doc_id", "text"), quality_rules.fit(wide, marks))
    assert by_id(found, *quality_rules.BASE) == sorted(((r[0], *base_counts(r[1])) for r in rows), key=str)
    assert quality_rules.filter_documents(wide, marks).columns == wide.columns


def test_jaccard(wide):
    found = by_id(jaccard_join.join(wide), "class_id", "n_links")
    assert found == sorted([(0, 0, 1), (1, 0, 1), (2, 2, 0), *[(3, 3, 4)] * 3, (4, 3, 4), (None, 3, 4), (5, 5, 0), (6, 6, 0)], key=str)
    assert jaccard_join.one_of_each(wide).columns == wide.columns


def test_decontamination(spark, wide, rows):
    benchmark = spark.createDataFrame([(7, ITEM, "x"), (7, ITEM, "y"), (8, "not " * 30, "z")], "item_id int, text string, doc_id string")
    found = decontamination.matches(wide, benchmark)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()} == {(0, 7, 0), (1, 7, 0)}
    assert {normal(rows[r["doc_id"]][1])[r["first_word"]] for r in found.collect()} == {"item0"}
    clean = decontamination.clean_documents(wide, benchmark)
    assert clean.columns == wide.columns and clean.count() == len(rows) - 2


def test_sharding(wide, rows):
    found = sharding.shard(wide, shards=3)
    assert by_id(found, "size", "text_crc32") == sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)


def test_token_counts(wide, rows):
    assert by_id(token_counts.counted(wide).where("tokenizer = 'words-1'"), "tokens") == sorted(((r[0], len(split(r[1]))) for r in rows), key=str)


def test_language_model(wide, rows):
    docs = wide.drop("held_out").withColumn("held_out", F.lit(False))
    counts = language_model.word_counts(docs)
    found = language_model.score(docs.select("doc_id", "held_out", "text"), counts, language_model.train(docs, counts))
    assert by_id(found, "n_tokens", "n_known") == sorted(((r[0], len(split(r[1])) + 1, len(split(r[1])) + 1) for r in rows), key=str)
    assert found.where("isnan(score) or score >= 0").count() == 0


def test_personal_data(wide, rows):
    found = {(r["doc_id"], r["spans"]) for r in pii.digest(pii.detect(wide)).collect()}
    assert found == {(r[0], ",".join(personal(r[1]))) for r in rows}


def test_compression(wide, rows, marks):
    found = by_id(compression.score(wide, compression.fit(wide, marks)), "score")
    assert len(found) == len(rows) and all(0 <= r[1] <= 1 for r in found)
    assert len({r[1] for r in found if r[0] == 3}) == 1


def test_repeated_passages(wide, rows):
    found = dict(by_id(suffix_dedup.repeated_spans(wide), "n_repeated"))
    words = len(split(rows[0][1]))
    assert found == {0: words - 10, 1: words - 10, 2: 70, 3: 120, 4: 120, None: 120, 5: 0, 6: 0}


def test_mixing(wide, rows):
    found = mixing.mix(wide)
    assert by_id(found, "size") == sorted(((r[0], len(split(r[1]))) for r in rows), key=str)
    assert found.where("taken > 2 * size").count() == 0
