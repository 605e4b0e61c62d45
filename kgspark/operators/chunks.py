"""Chunks of documents for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<out:array<string>,cur:array<string>,len:int>"


def _clean(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def prose(lines: Column, most: int = 800) -> Column:
    """Paragraphs packed to about ``most`` characters, the last one of a chunk repeated in the next.

    One fold per document, so documents are independent of each other.
    """
    empty = F.array().cast("array<string>")

    def state(out: Column, cur: Column, length: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), length.cast("int").alias("len"))

    def step(s: Column, p: Column) -> Column:
        size = F.length(p) + 1
        last = F.element_at(s["cur"], -1)
        full = (F.size(s["cur"]) > 0) & (s["len"] + size > most)
        return F.when(full, state(F.concat(s["out"], F.array(F.array_join(s["cur"], "\n"))), F.array(last, p), F.length(last) + size)).otherwise(
            state(s["out"], F.concat(s["cur"], F.array(p)), s["len"] + size)
        )

    def finish(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(F.array_join(s["cur"], "\n")))).otherwise(s["out"])

    return F.aggregate(_clean(lines), state(empty, empty, F.lit(0)), step, finish)


def table_rows(rows: Column, most: int = 800, joiner: str = " │ ") -> Column:
    """Rows of cells packed to about ``most`` characters, the first row repeated on top of every chunk."""
    text = F.transform(rows, lambda r: F.array_join(r, joiner, ""))
    head, lines = F.get(text, F.lit(0)), _clean(F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0))))
    empty = F.array().cast("array<string>")

    def state(out: Column, cur: Column, length: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), length.cast("int").alias("len"))

    def whole(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.array_join(F.concat(F.array(head), s["cur"]), "\n")))

    def step(s: Column, line: Column) -> Column:
        size = F.length(line) + 1
        full = (F.size(s["cur"]) > 0) & (s["len"] + size > most)
        return F.when(full, state(whole(s), F.array(line), F.length(head) + size)).otherwise(state(s["out"], F.concat(s["cur"], F.array(line)), s["len"] + size))

    packed = F.aggregate(lines, state(empty, empty, F.length(head)), step, lambda s: F.when(F.size(s["cur"]) > 0, whole(s)).otherwise(s["out"]))
    alone = F.when(F.trim(head) != "", F.array(head)).otherwise(empty)
    return F.when(head.isNull(), empty).when(F.size(lines) == 0, alone).otherwise(packed)


def chunk_blocks(blocks: DataFrame, most: int = 800, blank: bool = False) -> DataFrame:
    """``file, seq, block, text`` from blocks (file, block_no, block, lines, rows); rows, where there are any, win over lines.

    With ``blank`` a block that gives no chunk stays as one row without text.
    """
    pieces = F.when(F.size("rows") > 0, table_rows(F.col("rows"), most)).otherwise(prose(F.col("lines"), most))
    each = blocks.select("file", "block_no", "block", (F.posexplode_outer if blank else F.posexplode)(pieces).alias("i", "text"))
    order = Window.partitionBy("file").orderBy("block_no", "i")
    return each.select("file", (F.row_number().over(order) - 1).alias("seq"), "block", "text")


def backfill(docs: DataFrame, chunks: DataFrame, skip: str = r"(?i)[.]dxf$", most: int = 800, blank: bool = False) -> DataFrame:
    """Chunks of the documents (file, text) that have none yet, drawings and those without a text left out.

    A text of blanks gives no chunk, so its document keeps having none; with ``blank`` it stays as one row without text.
    """
    todo = docs.where(~F.col("file").rlike(skip) & F.col("text").isNotNull()).join(chunks.select("file").distinct(), "file", "left_anti")
    rows = F.array().cast("array<array<string>>")
    return chunk_blocks(todo.select("file", F.lit(0).alias("block_no"), F.lit("text").alias("block"), F.split("text", "\n").alias("lines"), rows.alias("rows")), most, blank)


def capped_lines(lines: DataFrame, most: int) -> DataFrame:
    """Lines (file, block_no, line_no, line) up to ``most`` of each file, with the number left out on the last kept one."""
    order = Window.partitionBy("file").orderBy("block_no", "line_no")
    rows = lines.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("file"))}).where(F.col("place") <= most)
    return rows.withColumn("omitted", F.when(F.col("place") == most, F.col("n") - most).otherwise(0)).drop("place", "n")
