"""Shapes most like others: exact ranks by ``domain.shape_similarity``, each different shape compared once.

A score depends on the features alone.  So the first few objects of each shape by ``ord`` stand for all of it, shapes that are asked
for meet them in blocks, and a task adds up the similarities of the features' values, which are worked out once for each two values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.domain import SHAPE
from kgspark.functions.text import nospace

from .lineage import settle

ASKED, POOL = 500, 20_000  # shapes asked for and objects that meet in one task
TEXTS = ("vent_layout", "seal", "housing", "gasket", "lens")


def _plain(rows: DataFrame, *keep: str) -> DataFrame:
    """The features as columns: texts without blanks in lower case, the connector with its number; ``shape`` tells different ones apart."""
    f = lambda n: F.col(f"features.{n}")
    texts = (nospace(F.nullif(f(n), F.lit(""))).alias(n) for n in TEXTS)
    number = F.regexp_extract(f("connector"), "[0-9]+", 0).try_cast("int").cast("double")
    return rows.select(*keep, F.to_json("features").alias("shape"), f("vent_count").cast("double").alias("vent_count"), f("connector").alias("connector"), number.alias("number"), *texts)


def _codes(values: list) -> tuple[np.ndarray, list]:
    """Each row's place among the different values, and these."""
    places: dict = {}
    return np.array([places.setdefault(v, len(places)) for v in values]), [*places]


def _text(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return np.nan
    return 1.0 if a == b else 0.5 if a in b or b in a else 0.0


def _grade(a: tuple | None, b: tuple | None) -> float:
    if a is None or b is None:
        return np.nan
    return 1.0 if a[0] == b[0] else 0.5 if abs(a[1] - b[1]) <= 1 else 0.0


def _vent(a: tuple | None, b: tuple | None) -> float:
    if a is None or b is None:
        return np.nan
    gap, layout = abs(a[0] - b[0]), _text(a[1], b[1])
    return (1.0 if gap == 0 else 0.4 if gap == 1 else 0.0) * 0.6 + (0.0 if np.isnan(layout) else layout) * 0.4


def _values(rows: pd.DataFrame) -> dict[str, list]:
    """The values of each weighted feature, in the order in which scores are added up."""
    none = lambda n: [x if isinstance(x, str) else None for x in rows[n]]
    vents = [(c, t) if c == c else None for c, t in zip(rows["vent_count"], none("vent_layout"))]
    grades = [(t, x) if t is not None else None for t, x in zip(none("connector"), rows["number"])]
    out = {"vent": vents, "connector": grades}
    return {n: out[n] if n in out else none(n) for n in SHAPE}


def scores(asked: pd.DataFrame, pool: pd.DataFrame):
    """For each row of ``asked`` the scores of all rows of ``pool``, as ``shape_similarity`` gives them."""
    likeness = {"vent": _vent, "connector": _grade}
    one, other, features = _values(asked), _values(pool), []
    for name, weight in SHAPE.items():
        (ia, va), (ib, vb) = _codes(one[name]), _codes(other[name])
        like = likeness.get(name, _text)
        alike = np.array([[like(a, b) for b in vb] for a in va])
        known = ~np.isnan(alike)
        features.append((ia, ib, np.where(known, alike * weight, 0.0), np.where(known, weight, 0.0)))
    for i in range(len(asked)):
        score = total = 0.0
        for ia, ib, part, weight in features:
            score = score + part[ia[i]][ib]
            total = total + weight[ia[i]][ib]
        of = np.divide(score, total, out=np.full(len(pool), -1.0), where=total > 0)
        yield np.where(of >= 0, np.floor(np.round(of * 100 + 0.5, 9)) / 100, 0.0)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores; among equal ones the first."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, -k)[-k]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])


def most_alike(asked: DataFrame, pool: DataFrame, top: int, asked_block: int = ASKED, pool_block: int = POOL) -> DataFrame:
    """``id, other, ord, score, place``: the ``top`` objects of ``pool`` (id, kind, features, ord) with a shape most like that of each row of ``asked`` (id, kind, features).

    Only objects of one kind, but not of one id, are compared; of equal scores the least ``ord`` is first.  Null kinds and ids meet nothing, scores of 0 are left out.
    """
    k = top + 1  # one of them may be the asked object itself
    mine = _plain(asked.where("id is not null and kind is not null"), "id", "kind")
    theirs = _plain(pool.where("id is not null and kind is not null").groupBy("id", "kind", "features", "ord").agg(F.count("*").alias("copies")), "id", "kind", "ord", "copies")
    first = Window.partitionBy("kind", "shape").orderBy("ord", "id")
    theirs = settle(theirs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n").join(mine.select("kind").distinct(), "kind", "left_semi"))
    wanted = settle(mine.drop("id").distinct())
    buckets = max(1, -(-theirs.count() // pool_block), -(-wanted.count() // asked_block))
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("kind"), F.lit(buckets)).cast("int"))
    blocks = lambda df, size: dealt(df).groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    cut = blocks(wanted, asked_block).withColumnRenamed("n", "a").join(blocks(theirs, pool_block).withColumnRenamed("n", "p"), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("kind", "shape"), F.col(n)).cast("int")
    left = dealt(wanted).join(cut, "bucket").withColumns({"ablock": own("a"), "pblock": every("p")}).drop("a", "p")
    right = dealt(theirs).join(cut, "bucket").withColumns({"pblock": own("p"), "ablock": every("a")}).drop("a", "p", "shape").withColumnRenamed("kind", "of")
    types = dict(pool.dtypes)
    schema = f"kind {types['kind']}, shape string, other {types['id']}, ord {types['ord']}, copies long, score double"

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = {kind: rows for kind, rows in others.sort_values(["ord", "id"]).groupby("of", sort=False)} if len(some) else {}
        out = []
        for kind, rows in some.groupby("kind", sort=False):
            if (near := others.get(kind)) is None:
                continue
            best, score = zip(*((first := _first(all_, k), all_[first]) for all_ in scores(rows, near)))
            found = near.iloc[np.concatenate(best)]
            shape = np.repeat(rows["shape"].to_numpy(), [len(b) for b in best])
            out.append(pd.DataFrame({"kind": kind, "shape": shape, "other": found["id"].to_numpy(), "ord": found["ord"].to_numpy(), "copies": found["copies"].to_numpy(), "score": np.concatenate(score)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["kind", "shape", "other", "ord", "copies", "score"])

    group = ["bucket", "ablock", "pblock"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, schema).where("score > 0")
    best = Window.partitionBy("kind", "shape").orderBy(F.desc("score"), "ord", "other")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    rows = mine.select("id", "kind", "shape").join(found, ["kind", "shape"]).where("id <> other")
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("id", "other", "ord", "score")
    place = Window.partitionBy("id").orderBy(F.desc("score"), "ord")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
