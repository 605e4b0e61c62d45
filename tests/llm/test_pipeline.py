"""The pipeline stage by stage against plain versions of each stage."""

from collections import Counter

import corpus_pipeline
import pytest
from brute import base_counts, edit_distance, near, normal, split

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    item = " ".join(docs.where("doc_id = 9").first()["text"].split()[20:60])
    spark.createDataFrame([(0, item), (1, "no such words stand in any text of these")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, folder):
    quality, jaccard, clean, mixed, shards = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, folder)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns
    for r in rows:
        counts = base_counts(r[1])
        assert counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0]
    one = jaccard(spark, kept, folder)
    left = [tuple(r) for r in one.collect()]
    _, least = near(rows)
    assert len(left) == len({c if c is not None else r[1] for r, c in zip(rows, least)})
    assert set(left) <= set(rows)
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    pure = clean(spark, one, folder)
    expected = [r for r in left if not any(edit_distance(normal(i), normal(r[1])) <= 0.2 * len(normal(i)) for i in items)]
    assert sorted(map(str, map(tuple, pure.collect()))) == sorted(map(str, expected)) and len(expected) < len(left)
    taken = mixed(spark, pure, folder)
    times = Counter(r["doc_id"] for r in taken.collect())
    assert taken.columns == docs.columns and max(times.values()) <= 2
    assert abs(sum(len(split(r["text"])) for r in taken.collect()) - 1.5 * sum(len(split(r[1])) for r in expected)) < 0.15 * sum(len(split(r[1])) for r in expected)
    out = shards(spark, taken, folder)
    assert out.count() == taken.count()


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(found.columns) and found.count() > 10


def test_empty_tables(spark, empty, labels, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
