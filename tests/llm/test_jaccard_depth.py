"""The prefix length of the Jaccard join: every text's size counts, however rare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import jaccard_join

# sets of 7 grams are at least 6 / 7 similar to others from 0.8 on, for which whole slices do; sets of 100 can be just 0.8 similar
SMALL_ONES, LARGE_ONES = 5000, 20


def sizes(spark):
    rows = spark.range(SMALL_ONES + LARGE_ONES).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("key"), "id")
    return rows.select("key", F.when(F.col("id") < SMALL_ONES, 7).otherwise(100).cast("long").alias("grams"))


def missed(similarity, depth):
    return (1 - similarity**depth) ** jaccard_join.TREES


def test_depth_reaches_the_target_for_rare_sizes(spark):
    every = sizes(spark)
    assert jaccard_join.measured_depth(every.where("grams = 7"), 0.8, 0.999) == jaccard_join.DEPTH
    depth = jaccard_join.measured_depth(every, 0.8, 0.999)
    assert missed(0.8, depth) <= 0.001 < missed(0.8, depth + 1)


def test_depth_does_not_depend_on_keys_or_counts(spark):
    every = sizes(spark)
    other = every.withColumn("key", F.unhex(F.md5("key"))).unionByName(every.where("grams = 7"))
    assert jaccard_join.measured_depth(every, 0.8, 0.999) == jaccard_join.measured_depth(other, 0.8, 0.999)
    assert jaccard_join.measured_depth(every.limit(0), 0.8, 0.999) == jaccard_join.DEPTH


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.93])
def test_least_similar_is_the_least_of_all_ways(threshold):
    for size in range(1, 80):
        ways = [(t, a) for t in range(size) for a in range(size + 2) if (size - t) / (size + a) >= threshold - 1e-9]
        taken, added = jaccard_join.least_similar(size, threshold)
        assert (size - taken) / (size + added) == pytest.approx(min((size - t) / (size + a) for t, a in ways))


def test_signatures_miss_as_often_as_computed():
    random = np.random.default_rng(3)
    for size in (5, 40):
        taken, added = jaccard_join.least_similar(size, 0.8)
        one, other = [], []
        for _ in range(4000):
            grams = random.integers(0, 1 << 64, size + added, dtype=np.uint64)
            one.append(jaccard_join.minima(grams[:size]))
            other.append(jaccard_join.minima(grams[taken:]))
        met = jaccard_join.shared_prefix(np.array(one), np.array(other)).max(axis=1)
        for depth in (4, 5, 6):
            expected = missed((size - taken) / (size + added), depth)
            assert abs((met < depth).mean() - expected) <= 4 * (expected / 4000) ** 0.5
