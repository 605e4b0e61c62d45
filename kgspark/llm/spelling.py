"""Spelling variant grouping by PartEnum signatures.

A word's letters are a multiset, written as a binary vector with one place for each (letter, occurrence).  Words one insertion,
deletion or replacement apart have vectors at a Hamming distance of at most two.  The places are dealt to ``parts`` parts by hash;
two differences touch at most two parts, so the words agree in all parts but some two: every choice of two parts to leave
out gives a signature, and near words share one at least.  Many words have the same letters in other orders, so the
signatures are joined together with a stretch that the two words must share as well: with one change, their first or
their last half is the same.  What meets in the equi-join is verified by its edit distance; nothing is dropped.

``parts`` grows with the number of words, so that a signature stays about as selective in a larger vocabulary; any number gives the
same rows.

Typing errors for the query are made from the id and the word: if 97 divides the CRC of ``<doc_id>:<word>``, one letter is lost.

Defined results: null and empty texts have no words; very long texts are read whole; a null id counts as the empty string;
repeated rows count again; of near words with equally many occurrences the first in code-point order is the form; an empty table
gives no rows; only ``doc_id`` and ``text`` are read, so extra columns, clashing names among them, do not matter.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: every run of letters of every text, with A-Z in lower case."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def mistyped(doc_id: Column, run: Column, rate: int = 97) -> Column:
    """The run, short of one code point where ``rate`` divides the CRC of the id and the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % rate == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def vocabulary(found: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: words of some length that occur often enough."""
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def vector_parts(word: Column, parts: int) -> list[Column]:
    """One value for each part of the word's letter vector; equal if the vectors agree there."""
    letters = F.array_sort(F.split(word, ""))
    places = F.transform(letters, lambda x, i: F.xxhash64(x, i - F.array_position(letters, x)))

    def part(p: int) -> Column:
        return F.aggregate(F.filter(places, lambda e: F.pmod(e, F.lit(parts)) == p), F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(e))

    return [part(p) for p in range(parts)]


def signed(words: DataFrame, parts: int) -> DataFrame:
    """``key, word, n``: a row for each signature of a word and each half that a near word can share with it.

    A half is of the shorter word of a pair: a word of even length, as the longer one, also has the halves of a word one shorter.
    """
    several = [f"_p{i}" for i in range(parts)]
    rows = words.select("word", "n", F.length("word").alias("size"), F.array(*vector_parts(F.col("word"), parts)).alias("_parts"))
    rows = rows.select("word", "n", "size", *(F.col("_parts")[i].alias(c) for i, c in enumerate(several)))
    left_out = list(combinations(range(parts), 2))
    signatures = F.array(*(F.xxhash64(F.lit(c), *(F.col(several[i]) for i in range(parts) if i not in out)) for c, out in enumerate(left_out)))
    half = F.floor(F.col("size") / 2).cast("int")
    lengths = F.when(F.col("size") % 2 == 0, F.array(half, half - 1)).otherwise(F.array(half))
    rows = rows.select("word", "n", "size", signatures.alias("_signatures"), F.explode(lengths).alias("_half"))
    first = F.xxhash64(F.lit("first"), "_half", F.col("word").substr(F.lit(1), F.col("_half")))
    last = F.xxhash64(F.lit("last"), "_half", F.col("word").substr(F.col("size") - F.col("_half") + 1, F.col("_half")))
    rows = rows.select("word", "n", "size", "_signatures", F.explode(F.array(first, last)).alias("_shared"))
    return rows.select(F.explode(F.transform("_signatures", lambda s: F.xxhash64(s, F.col("_shared")))).alias("key"), "word", "n")


def parts_for(n_words: int) -> int:
    """More parts for more words: the part of a vector that a signature keeps, 1 - 2 / parts, grows with them."""
    return 4 + max(0, math.ceil(math.log(max(n_words, 1) / 400_000, 4)))


def near_pairs(words: DataFrame, parts: int) -> DataFrame:
    """``a, b, a_n, b_n`` with a < b: all pairs of words that are one change apart, once each."""
    keyed = signed(words, parts)
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Every row of ``word, n`` (one a word) with ``form, root, n_near, form_n``.

    Each form occurs at least ``ratio`` times as often as the word before, so chains are no longer than the logarithm of the
    largest count, and the doubling of links below ends after a few rounds known beforehand.
    """
    words = settle(words.select("word", F.col("n").cast("long").alias("n")))
    n_words, most = words.agg(F.count("*"), F.max("n")).first()
    pairs = settle(near_pairs(words, parts_for(n_words)))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.w"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))
    rows = settle(rows)
    link = rows.where("form is not null").select("word", F.col("form").alias("root"))
    longest = math.log(max(most or 1, ratio), ratio) + 1
    for _ in range(math.ceil(math.log2(longest))):
        link = settle(link.join(link.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return rows.join(link, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_partenum_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents")).select(mistyped(F.col("doc_id"), F.col("run")).alias("word"))
    return group_variants(vocabulary(found))


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
  FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs), crc_table),
typed AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM coded),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(64) r(i) WHERE i < length(word)
  UNION ALL SELECT word, n, length(word), i, substr(word, 1, i) || substr(word, i + 2) FROM words, LATERAL (SELECT unnest(range(64, length(word))) AS i) WHERE length(word) > 64),
near AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""
