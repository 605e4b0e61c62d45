"""Shapes most like others against all pairs in plain Spark, on odd features, ties, copies of rows and cut blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import domain
from kgspark.operators import drawings, shapes

SCHEMA = "id string, kind string, features struct<vent_count:int,vent_layout:string,seal:string,housing:string,connector:string,gasket:string,lens:string>, ord long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    pick = lambda *values: rng.choice(values)
    shape = lambda: (pick(0, 1, 3, None), pick("up", "up, down", "", None), pick("EPDM", "epdm 70", " ", None), pick("PC", "PC ABS", "glass"), pick("IP6", "IP67", "6", "x", None), pick("a", None), pick("l", "L 1", "m"))
    out = [(f"P{i}", pick("one", "two", None), shape(), i) for i in range(150)]
    out += [(f"Q{i}", "one", out[3][2], 200 + i) for i in range(12)] + [out[3], out[3], (None, "one", out[3][2], 300), ("R", "three", out[3][2], 301), ("S", "one", None, 302)]
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


def brute(asked, pool, top):
    one, other = asked.select("id", "kind", F.col("features").alias("f")), pool.select(F.col("id").alias("other"), F.col("kind").alias("k"), F.col("features").alias("h"), "ord")
    pairs = one.join(other, (F.col("kind") == F.col("k")) & (F.col("id") != F.col("other"))).select("id", "other", "ord", domain.shape_similarity("f", "h").alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ord"))
    return plain(pairs.withColumn("place", place).where(F.col("place") <= top))


def plain(df):
    return sorted((r["id"], r["other"], r["score"], r["place"]) for r in df.collect())


@pytest.mark.parametrize("blocks", [(500, 20_000), (3, 10)])
def test_most_alike_equals_all_pairs(rows, blocks):
    asked = rows.where("ord % 3 = 0 or ord > 200")
    found = plain(shapes.most_alike(asked, rows, 4, *blocks))
    assert len(found) > 150
    assert found == brute(asked, rows, 4)


def test_equal_shapes_meet_once(spark):
    """All pairs of these are 400 million, of their shapes 144."""
    shape = "named_struct('vent_count', int(id % 4), 'vent_layout', 'up', 'seal', string(id % 3), 'housing', 'H', 'connector', 'IP6', 'gasket', string(null), 'lens', 'L') as features"
    many = spark.range(20_000).selectExpr("id", shape, "id as ord")
    found = drawings.similar_projects(many, many).where("place = 4")
    assert found.count() == 20_000
    assert {(r["id"], r["other"], r["score"]) for r in found.where("id in (0, 12, 48, 19999)").collect()} == {(0, 48, 1.0), (12, 48, 1.0), (48, 36, 1.0), (19999, 43, 1.0)}
