"""An inverted-list index over vectors, exact by the triangle inequality of angles.

Every vector belongs to the list of its nearest centre.  A list is sorted by the angle to its centre and cut into rings of at most
``ring`` vectors, each one packed row with its least and largest angle; so a hot list is many rings, and no task holds more
than a ring.  Nothing in a ring can be nearer to a query than the gap between the query's angle to the centre and the ring's.

A search first sends each query to its most promising rings; its k-th best distance there rules out most others, and the query
goes only to those that may still hold something as near.  Queries are rows of a DataFrame throughout: the vectors are read twice
for any number of queries, and queries that meet in one ring are dealt to several copies of it.  To the driver go the centres, learnt
from a bounded sample, and the directory of rings, one small row for each ``ring`` vectors or kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import settle, shared_folder

MARGIN = 1e-6  # of an angle, for rounding


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding has a length."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (square > 0))


def kind_key(rows: DataFrame) -> Column:
    """The kind as text; null, or no such column, is a kind too."""
    kind = F.col("kind").cast("string") if "kind" in rows.columns else F.lit("")
    return F.coalesce(F.concat(F.lit("k"), kind), F.lit("")).alias("kind")


def _units(packed: np.ndarray | pd.Series, size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), dtype=np.float32).reshape(-1, size).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def spread_centres(x: np.ndarray, most: int) -> np.ndarray:
    """Each next centre is the vector farthest from those before, so the first ones alone cover the sample well too."""
    if not len(x):
        return x
    chosen, gap = [0], _angles(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)) and gap.max() > 1e-9:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _angles(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]


@dataclass
class VectorIndex:
    """Rings in Parquet, and the centres of each size of vectors."""

    spark: SparkSession
    folder: str
    centres: dict[int, np.ndarray]

    @cached_property
    def rings(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    @cached_property
    def directory(self) -> pd.DataFrame:
        names = ["kind", "size", "list", "low", "high", "n", "last", "chunk"]
        return self.rings.select(*names).toPandas().sort_values("chunk", ignore_index=True)


def build(vectors: DataFrame, ring: int = 4096, lists: int = 1024, sample: int = 20_000) -> VectorIndex:
    """Index of vectors (id, embedding, and kind if they have one; null is a kind too).

    Centres come from the ``sample`` vectors with the smallest hash of their id, of each size; all vectors are indexed.  A kind uses as many of
    the centres as it has rings, ``lists`` at most.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).select("id", kind_key(vectors), F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("size"))
    kinds = rows.groupBy("kind", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("size").orderBy(F.xxhash64("id"), "id")
    chosen = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).orderBy("size", "r").select("size", "embedding").collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(r["size"], []).append(r["embedding"])
    centres = {}
    for size, some in by_size.items():
        x = np.array(some, dtype=np.float64)
        centres[size] = spread_centres(x / np.linalg.norm(x, axis=1, keepdims=True), lists)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, same in batch.groupby("size", sort=False):
                c = shared.value[size]
                packed = [np.asarray(v, dtype=np.float32).tobytes() for v in same["embedding"]]
                angle = _angles(_units(packed, size), c)
                angle[np.arange(len(c))[None, :] >= np.maximum(-(-same["n"].to_numpy() // ring), 1)[:, None]] = np.inf
                own = angle.argmin(axis=1)
                yield same.assign(list=own.astype(np.int32), angle=angle[np.arange(len(own)), own], packed=packed)[["id", "kind", "size", "list", "angle", "packed"]]

    id_kind = vectors.schema["id"].dataType.simpleString()
    dealt = rows.join(kinds, ["kind", "size"]).mapInPandas(assign, f"id {id_kind}, kind string, size int, list int, angle double, packed binary")
    schema = f"chunk string, kind string, size int, list int, low double, high double, n long, last {id_kind}, ids array<{id_kind}>, packed binary"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted; each run of one list gives rings."""
        held: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            marks = list(zip(batch["kind"], batch["size"], batch["list"]))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and (marks[a] != key or sum(map(len, held)) >= ring):
                    yield from rings_of(held)
                    held = []
                key = marks[a]
                held.append(batch.iloc[a:b])
        if held:
            yield from rings_of(held)

    def rings_of(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held)
        for at in range(0, len(rows), ring):
            r = rows.iloc[at : at + ring]
            first = r.iloc[0]
            yield pd.DataFrame([{
                "chunk": uuid.uuid4().hex, "kind": first["kind"], "size": first["size"], "list": first["list"], "low": r["angle"].min(), "high": r["angle"].max(),
                "n": len(r), "last": r["id"].max(), "ids": list(r["id"]), "packed": b"".join(r["packed"]),
            }])

    order = ("kind", "size", "list", "angle", "id")
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, schema).write.parquet(folder)
    return VectorIndex(spark, folder, centres)


def search(
    index: VectorIndex, queries: DataFrame, k: int, most: float | None = None, later: bool = False, first: int = 2, exact: bool = True, meet: int = 4096, report: Observation | None = None
) -> DataFrame:
    """``qid, id, distance, place``: the k nearest vectors of each query (qid, embedding, kind if the index has kinds) by cosine.

    ``most`` leaves out what is not nearer than that, ``later`` all but larger ids than the query's.  Without ``exact`` only the ``first`` rings are looked
    into.  ``report`` observes ``pairs``, the number of vectors compared.  Queries without length, or of a size or kind that the index does not
    have, find nothing.
    """
    spark = index.spark
    asked = usable(queries).select("qid", kind_key(queries), F.col("embedding").cast("array<float>").alias("embedding"))
    book = index.directory
    shared = spark.sparkContext.broadcast((index.centres, {key: d.reset_index(drop=True) for key, d in book.groupby(["kind", "size"])}))
    qkind, idkind = queries.schema["qid"].dataType.simpleString(), index.rings.schema["last"].dataType.simpleString()
    visit_schema = f"qid {qkind}, packed binary, chunk string, n long"

    def visits(batches: Iterator[pd.DataFrame], round_: int) -> Iterator[pd.DataFrame]:
        """The rings to visit: the first ones, or all others that the bound of a query leaves open."""
        centres, by_kind = shared.value
        for batch in batches:
            for key, same in batch.groupby([batch["kind"], batch["embedding"].map(len)], sort=False):
                held = by_kind.get(key)
                if held is None:
                    continue
                for at in range(0, len(same), 512):
                    some = same.iloc[at : at + 512]
                    packed = [np.asarray(v, dtype=np.float32).tobytes() for v in some["embedding"]]
                    angle = _angles(_units(packed, key[1]), centres[key[1]])[:, held["list"].to_numpy()]
                    bound = np.maximum(np.maximum(angle - held["high"].to_numpy(), held["low"].to_numpy() - angle), 0)
                    if later:
                        bound[some["qid"].to_numpy()[:, None] >= held["last"].to_numpy()[None, :]] = np.inf
                    seen = np.lexsort((angle, bound), axis=1)[:, :first]  # nearest by bound, then by centre
                    open_ = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(open_, seen, True, axis=1)
                    limit = np.full(len(some), np.pi) if most is None else np.full(len(some), np.arccos(np.clip(1 - most, -1, 1)))
                    if round_ == 2:
                        own = np.arccos(np.clip(1 - some["worst"].to_numpy(dtype=float), -1, 1))
                        limit, open_ = np.fmin(limit, own), ~open_
                    q, r = np.nonzero(open_ & (bound <= limit[:, None] + MARGIN))
                    yield pd.DataFrame({"qid": some["qid"].to_numpy()[q], "packed": np.array(packed, dtype=object)[q], "chunk": held["chunk"].to_numpy()[r], "n": held["n"].to_numpy()[r]})

    def best(queries_: pd.DataFrame, ring: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries_) and len(ring):
            row = ring.iloc[0]
            x, ids = _units([row["packed"]], row["size"]), np.asarray(row["ids"])
            for at in range(0, len(queries_), 512):
                some = queries_.iloc[at : at + 512]
                distance = 1 - _units(some["packed"], row["size"]) @ x.T
                own = some["qid"].to_numpy()
                if later:
                    distance[ids[None, :] <= own[:, None]] = np.inf
                limit = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(some), 1), np.inf)
                keep = (distance <= limit) & np.isfinite(distance)
                if most is not None:
                    keep &= distance < most
                q, r = np.nonzero(keep)
                out.append(pd.DataFrame({"qid": own[q], "id": ids[r], "distance": distance[q, r]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "distance": []})

    def compared(rows: DataFrame) -> DataFrame:
        """Queries meet rings; where more than ``meet`` of them ask for one, they are dealt to copies of it."""
        copies = rows.groupBy("chunk").agg(F.ceil(F.count("*") / meet).cast("int").alias("copies"))
        left = rows.join(copies, "chunk").withColumn("copy", F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int"))
        right = index.rings.join(copies, "chunk").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        return left.groupBy("chunk", "copy").cogroup(right.select("chunk", "copy", "size", "ids", "packed").groupBy("chunk", "copy")).applyInPandas(lambda a, b: best(a, b), f"qid {qkind}, id {idkind}, distance double")

    order = Window.partitionBy("qid").orderBy("distance", "id")
    top = lambda rows: rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    begin = settle(asked.mapInPandas(lambda b: visits(b, 1), visit_schema))
    seen = settle(top(compared(begin)))
    if not exact:
        return top(seen.drop("place"))
    worst = seen.where(F.col("place") == k).select("qid", F.col("distance").alias("worst"))
    more = settle(asked.join(worst, "qid", "left").mapInPandas(lambda b: visits(b, 2), visit_schema))
    if report is not None:
        begin.select("n").unionByName(more.select("n")).observe(report, F.sum("n").alias("pairs")).count()
    return top(seen.drop("place").unionByName(compared(more)))
