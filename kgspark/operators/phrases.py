"""Which names of a dictionary a text holds: one walk of a multi-pattern automaton (Aho and Corasick) over every text.

The walk is linear in the text whatever the number of names.  A dictionary is cut by its first characters into parts of at most
``PART`` characters; a single part goes to all tasks, which walk the texts where they are.  More parts meet the texts
by a shuffle: a text goes once to each part that has a name beginning with one of its characters, so that each task holds one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

PART = 4_000_000  # characters of names in one automaton: some hundred MB
BLOCK = 2_000  # texts that meet a part in one task


def automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, word)
    out.make_automaton()
    return out


def words_in(known: ahocorasick.Automaton, text: str | None) -> set[str]:
    return {word for _, word in known.iter(text)} if text and len(known) else set()


def held(texts: DataFrame, words: DataFrame, part: int = PART) -> DataFrame:
    """Rows of ``texts`` (keys and ``t``) with each different ``word`` that their text holds; ``words`` may have ``canvas_id`` too.

    Nulls and empty words or texts hold nothing; extra columns of ``words`` are not read.
    """
    shared = [k for k in ("canvas_id",) if k in texts.columns and k in words.columns]
    known = settle(words.select(*shared, "word").where(F.length("word") > 0).distinct())
    size = known.select("word").distinct().agg(F.sum(F.length("word"))).first()[0] or 0
    keys = [k for k in texts.columns if k != "t"]
    found = _walked(texts, known, keys) if size <= part else _met(texts, known, keys, part)
    return found.join(known, [*shared, "word"]).select(*keys, "word") if shared else found


def _walked(texts: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The dictionary, of a size counted before, goes to all tasks."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(sorted(r[0] for r in known.select("word").distinct().collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton(shared.value)
        for batch in batches:
            found = [sorted(words_in(tree, t.as_py())) for t in batch["t"]]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            held_words = pa.array([w for f in found for w in f], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[k].take(rows) for k in keys), held_words], names=[*keys, "word"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "t")
    return texts.where(F.length("t") > 0).select(*keys, "t").mapInArrow(run, f"{schema}, word string")


def _met(texts: DataFrame, known: DataFrame, keys: list[str], part: int) -> DataFrame:
    """The dictionary in parts; those of a first character that has too many names are dealt by hash."""
    names = known.select("word").distinct().withColumn("head", F.substring("word", 1, 1))
    heads = names.groupBy("head").agg(F.sum(F.length("word")).alias("size"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # one row for each first character
    heads = heads.select("head", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / part).cast("int").alias("place"), F.ceil(F.col("size") / part).cast("int").alias("salts"))
    heads = settle(heads)
    dealt = names.join(F.broadcast(heads), "head").select(F.concat_ws("-", "place", F.pmod(F.xxhash64("word"), F.col("salts"))).alias("part"), "word")
    wanted = heads.select("head", F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.concat_ws("-", F.col("place"), s))).alias("part"))
    rows = settle(texts.where(F.length("t") > 0).select(F.struct(*keys).alias("own"), "t", F.monotonically_increasing_id().alias("row")))
    letters = rows.select("row", F.explode(F.array_distinct(F.split("t", ""))).alias("head")).join(F.broadcast(wanted), "head").select("row", "part").distinct()
    blocks = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-rows.count() // BLOCK)))).cast("int")
    left = letters.join(rows, "row").select("part", blocks.alias("block"), "row", "t")
    asking = settle(left.select("part", "block").distinct())
    right = dealt.groupBy("part").agg(F.collect_list("word").alias("words")).join(asking, "part")

    def run(some: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        tree = automaton(sorted({w for each in names["words"] for w in each}))
        out = [(row, word) for row, t in zip(some["row"], some["t"]) for word in sorted(words_in(tree, t))]
        return pd.DataFrame(out, columns=["row", "word"])

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, "row long, word string")
    return met.join(rows, "row").select("own.*", "word")
