"""Token counts as delta-maintained rollups.

A change has a kind (insert, delete, revise), the row's source, language and tokenizer version, its count, and for a
revision the count it replaces.  A batch of changes is summed to one signed row per group and committed under
its batch id.  A commit adds these deltas to the running totals, after taking away those of an earlier commit
of the same id, so a repeated or resumed batch counts once; its work grows with the batch and the number of groups.  Of
earlier batches it reads no counts, only the log, which has one small row each.

Nothing is overwritten: deltas and new totals are written to folders of their own, and the commit is the one row appended to
the log that names them.  A job that dies before leaves the last totals in force, and its batch can be sent again.  There
must be one writer at a time.

Tokenizer versions are column expressions from a text to its count.

Defined results: null texts have no tokens but count as a document; very long texts are counted whole; null sources,
languages and versions are groups of their own; an unknown kind of change is an error; groups whose documents and tokens add
up to zero are left out of the totals; an empty batch changes nothing; repeated changes within a batch count as often as they stand
there; ties do not arise, as counts are sums; extra columns, clashing names among them, are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.lineage import shared_folder

from .common import WORD, settle, table

GROUP = ("source", "lang", "tokenizer")
PIECE = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"

Tokenizer = Callable[[Column], Column]


def pattern_tokenizer(pattern: str) -> Tokenizer:
    """Counts the matches of a pattern."""
    return lambda text: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


TOKENIZERS: Mapping[str, Tokenizer] = {"words-1": pattern_tokenizer(WORD), "pieces-1": pattern_tokenizer(PIECE)}


def counted(docs: DataFrame, tokenizers: Mapping[str, Tokenizer] = TOKENIZERS) -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens``: one row per document and tokenizer version."""
    counts = docs.select("doc_id", "source", "lang", *(t(F.col("text")).alias(f"n{i}") for i, t in enumerate(tokenizers.values())))
    each = F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, name in enumerate(tokenizers)))
    return counts.select("doc_id", "source", "lang", F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.tokenizer", "t.tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed documents and tokens of each group from ``kind, source, lang, tokenizer, tokens, old_tokens``."""
    kind = F.col("kind")
    known = kind.isin("insert", "delete", "revise")
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    sign = F.when(known, sign).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.coalesce("tokens", F.lit(0))
    signed = F.when(kind == "delete", -tokens).when(kind == "revise", tokens - F.coalesce("old_tokens", F.lit(0))).otherwise(tokens)
    return changes.groupBy(*GROUP).agg(F.sum(sign).cast("long").alias("documents"), F.sum(signed).cast("long").alias("tokens"))


class Rollup:
    """Running totals in a folder that all executors share."""

    LOG = "version long, batch long, deltas string, totals string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.LOG)  # nothing is committed yet

    def _groups(self, folder: str | None) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Brings the deltas of a batch into the totals, in place of those of an earlier commit of the same id."""
        of_batch = F.when(F.col("batch") == int(batch), F.col("version"))
        last, totals, earlier = self._log().agg(F.max("version"), F.max_by("totals", "version"), F.max_by("deltas", of_batch)).first()
        new = uuid.uuid4().hex
        deltas(changes).write.parquet(f"{self.path}/deltas/{new}")
        minus = self._groups(earlier).withColumns({c: -F.col(c) for c in ("documents", "tokens")})
        parts = self._groups(totals).unionByName(minus).unionByName(self._groups(f"deltas/{new}"))
        sums = parts.groupBy(*GROUP).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")))
        sums.where("documents <> 0 or tokens <> 0").write.parquet(f"{self.path}/totals/{new}")
        row = [((last or 0) + 1, int(batch), f"deltas/{new}", f"totals/{new}")]
        self.spark.createDataFrame(row, self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def for_each_batch(self) -> Callable[[DataFrame, int], None]:
        """A sink for ``writeStream.foreachBatch``: replayed micro-batches replace themselves."""
        return lambda changes, batch: self.commit(batch, changes)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches."""
        return self._groups(self._log().agg(F.max_by("totals", "version")).first()[0])


def op5_delta_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed over all documents, in three batches of which the second is delivered twice.

    Batch 0 inserts every document with its words.  Batch 1 deletes the documents that ``labels`` marks as toxic.  Batch
    2 brings a second tokenizer version for every document and revises, under the first, the counts of those with a
    mark of low quality to 0.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = settle(counted(docs).join(marks, "doc_id", "left").drop("doc_id"))  # every text is counted once
    words, pieces = counts.where("tokenizer = 'words-1'"), counts.where("tokenizer = 'pieces-1'")
    change = lambda rows, kind, tokens="tokens", old="0": rows.select(F.lit(kind).alias("kind"), *GROUP, F.expr(tokens).cast("long").alias("tokens"), F.expr(old).cast("long").alias("old_tokens"))
    rollup = Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(0, change(words, "insert"))
    deleted = change(words.where("toxic = 1"), "delete")
    rollup.commit(1, deleted)
    rollup.commit(1, deleted)
    revised = change(words.where("coalesce(toxic, 0) <> 1 and quality = 0"), "revise", "0", "tokens")
    rollup.commit(2, change(pieces, "insert").unionByName(revised))
    return rollup.totals()


_WORD_SQL = re.sub(r"'", "''", WORD)
ORACLE = f"""
with marks as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
words as (
  select d.doc_id, d.source, d.lang, m.toxic, m.quality,
         coalesce(len(regexp_extract_all(d.text, '{_WORD_SQL}')), 0) as tokens
  from documents d left join marks m on d.doc_id = m.doc_id),
rows as (
  select source, lang, 'words-1' as tokenizer, 1 as documents,
         case when quality = 0 then 0 else tokens end as tokens
  from words where coalesce(toxic, 0) <> 1
  union all
  select source, lang, 'pieces-1', 1, coalesce(len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]')), 0)
  from documents)
select source, lang, tokenizer, cast(sum(documents) as bigint) as documents, cast(sum(tokens) as bigint) as tokens
from rows group by source, lang, tokenizer
"""
