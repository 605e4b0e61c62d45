"""Office files, mails and drawings as tables.

Readers take ``binaryFile`` rows (path, content) and parse each file inside a task; a file that cannot be read gives a
row with its error, never a failed job.  Drawings in text form are parsed by DataFrame operations alone.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions.text import stripped_html


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, without lock files, as (path, file, length, content)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), "length", "content").where(~F.col("file").startswith("~$"))


def _reader(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows that ``parse`` gives for each file's bytes, with ``file`` in front and ``error`` behind."""
    names = [part.split()[0] for part in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                try:
                    rows = [(name, *row, None) for row in parse(bytes(content))]
                except Exception as failure:  # a broken file must not end the job
                    rows = [(name, *[None] * len(names), f"{type(failure).__name__}: {failure}")]
                yield pd.DataFrame(rows, columns=["file", *names, "error"])

    return files.select("file", "content").mapInPandas(run, f"file string, {columns}, error string")


def _clean(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").strip()


def _texts(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == tag)


def _all(node, tag: str) -> list:
    return [x for x in node.iter() if x.tag.rpartition("}")[2] == tag]


def _cell(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as BC12."""
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", ref).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits) - 1, column - 1


def _sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """Name, cells (row, column, text) and merged ranges of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        parsed = lambda part: ElementTree.fromstring(book.read(part))
        strings = [_texts(s, "t") for s in _all(parsed("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in parsed("xl/_rels/workbook.xml.rels")}
        for sheet in _all(parsed("xl/workbook.xml"), "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = targets[link].lstrip("/")
            tree = parsed(target if target.startswith("xl/") else f"xl/{target}")
            cells = []
            for cell in _all(tree, "c"):
                value = _texts(cell, "v")
                text = _texts(cell, "t") if cell.get("t") == "inlineStr" else strings[int(value)] if cell.get("t") == "s" and value else value
                if _clean(text):
                    cells.append((*_cell(cell.get("r")), _clean(text)))
            yield _clean(sheet.get("name")), cells, [m.get("ref") for m in _all(tree, "mergeCell")]


def read_cells(files: DataFrame) -> DataFrame:
    """``file, sheet, r, c, value, error``: non-empty cells of workbooks."""
    return _reader(files, lambda b: ((s, r, c, v) for s, cells, _ in _sheets(b) for r, c, v in cells), "sheet string, r int, c int, value string")


def read_merges(files: DataFrame) -> DataFrame:
    """``file, sheet, r1, c1, r2, c2, error``: merged ranges of workbooks."""

    def parse(content: bytes) -> Iterator[tuple]:
        for sheet, _, merges in _sheets(content):
            for merged in merges:
                one, _, other = merged.partition(":")
                yield sheet, *_cell(one), *_cell(other or one)

    return _reader(files, parse, "sheet string, r1 int, c1 int, r2 int, c2 int")


def read_records(cells: DataFrame) -> DataFrame:
    """``file, sheet, r, name, value``: cells below the first row under their header; columns without a header go."""
    good = cells.where("error is null")
    first = good.groupBy("file", "sheet").agg(F.min("r").alias("top"))
    rows = good.join(first, ["file", "sheet"])
    head = rows.where("r = top").select("file", "sheet", "c", F.col("value").alias("name"))
    return rows.where("r > top").join(head, ["file", "sheet", "c"]).select("file", "sheet", "r", "name", "value")


def filled(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the top left value of each merged range in all its empty places."""
    areas = merges.where("error is null").select("file", "sheet", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("r"), "c2")
    areas = areas.select("file", "sheet", "r1", "c1", "r", F.explode(F.sequence("c1", "c2")).alias("c"))
    good = cells.where("error is null").select("file", "sheet", "r", "c", "value")
    top = good.select("file", "sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("value").alias("top"))
    spread = areas.join(top, ["file", "sheet", "r1", "c1"]).select("file", "sheet", "r", "c", F.col("top").alias("value"))
    return good.unionByName(spread.join(good.select("file", "sheet", "r", "c"), ["file", "sheet", "r", "c"], "left_anti"))


def read_slides(files: DataFrame) -> DataFrame:
    """``file, slide, line_no, text, error``: paragraphs of slide decks, slides in the order of their numbers."""

    def parse(content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as deck:
            slides = sorted((int(m[1]), n) for n in deck.namelist() if (m := re.fullmatch(r"ppt/slides/slide([0-9]+)\.xml", n)))
            for number, name in slides:
                lines = [_clean(_texts(p, "t")) for p in _all(ElementTree.fromstring(deck.read(name)), "p")]
                for i, line in enumerate(x for x in lines if x):
                    yield number, i, line

    return _reader(files, parse, "slide int, line_no int, text string")


def read_paragraphs(files: DataFrame) -> DataFrame:
    """``file, line_no, text, error``: non-empty paragraphs of text documents."""

    def parse(content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as doc:
            lines = [_clean(_texts(p, "t")) for p in _all(ElementTree.fromstring(doc.read("word/document.xml")), "p")]
        yield from enumerate(x for x in lines if x)

    return _reader(files, parse, "line_no int, text string")


def source_blocks(cells: DataFrame, slides: DataFrame, paragraphs: DataFrame, most: int | None = 2000) -> DataFrame:
    """``file, block_no, label, lines, rows``: labelled blocks of source texts: a sheet, a slide, a document's paragraphs.

    cells, slides and paragraphs are what the readers give.  Sheets have their rows as cells too, empty rows left out.  With ``most``, a
    file's lines are cut there and its last block says how many there are; chunks need the whole, without it.
    """
    good = lambda df: df.where("error is null")
    listed = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
    # a row of a sheet has a place for every column up to its last one
    width = F.sequence(F.lit(0), F.max("c"))
    at = F.map_from_entries(F.collect_list(F.struct("c", "value")))
    grid = good(cells).groupBy("file", "sheet", "r").agg(F.transform(width, lambda i: F.coalesce(at[i], F.lit(""))).alias("row"))
    none = F.array().cast("array<array<string>>")
    sheets = grid.groupBy("file", "sheet").agg(listed("r", F.col("row")).alias("rows"))
    sheets = sheets.select("file", F.lit("sheet").alias("kind"), F.col("sheet").alias("label"), F.lit(0).alias("n"), F.transform("rows", lambda r: F.array_join(r, " │ ")).alias("lines"), "rows")
    decks = good(slides).groupBy("file", "slide").agg(listed("line_no", F.col("text")).alias("lines"))
    decks = decks.select("file", F.lit("slide").alias("kind"), F.concat(F.lit("슬라이드 "), F.col("slide").cast("string")).alias("label"), F.col("slide").alias("n"), "lines", none.alias("rows"))
    texts = good(paragraphs).groupBy("file").agg(listed("line_no", F.col("text")).alias("lines"))
    texts = texts.select("file", F.lit("text").alias("kind"), F.lit("본문").alias("label"), F.lit(0).alias("n"), "lines", none.alias("rows"))
    order = Window.partitionBy("file").orderBy("kind", "n", "label")
    blocks = sheets.unionByName(decks).unionByName(texts).withColumn("block_no", F.row_number().over(order) - 1)
    if most is None:
        return blocks.select("file", "block_no", "label", "lines", "rows")
    before = F.coalesce(F.sum(F.size("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_before": before, "_all": F.sum(F.size("lines")).over(Window.partitionBy("file"))}).where(F.col("_before") < most)
    left = (most - F.col("_before")).cast("int")
    cut = (F.col("_all") > most) & (F.col("_before") + F.size("lines") >= most)
    mark = F.concat(F.lit("… (이하 생략, 총 "), F.col("_all").cast("string"), F.lit("행)"))
    lines = F.slice("lines", F.lit(1), left)
    return blocks.select("file", "block_no", "label", F.when(cut, F.array_append(lines, mark)).otherwise(lines).alias("lines"), F.slice("rows", F.lit(1), left).alias("rows"))


def read_mails(files: DataFrame) -> DataFrame:
    """``file, sender, recipient, subject, date, body, error``: plain text of mails, else their stripped HTML; never fails."""

    def parse(content: bytes) -> Iterator[tuple]:
        mail = email.message_from_bytes(content, policy=email.policy.default)
        part = mail.get_body(preferencelist=("plain", "html"))
        body = "" if part is None else part.get_content()
        html = part is not None and part.get_content_type() == "text/html"
        yield *(" ".join(str(mail[h] or "").split()) for h in ("from", "to", "subject", "date")), body.strip(), html

    rows = _reader(files, parse, "sender string, recipient string, subject string, date string, body string, html boolean")
    return rows.withColumn("body", F.when(F.col("html"), stripped_html(F.col("body"))).otherwise(F.col("body"))).drop("html")


def drawing_entities(drawings: DataFrame) -> DataFrame:
    """``file, entity, kind, layer, x, y, height, value`` from (file, text) of code and value line pairs.

    Pairs become rows, each code 0 starts an entity, and the codes of an entity become its columns.
    """
    lines = drawings.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    pairs = lines.groupBy("file", F.floor(F.col("i") / 2).alias("n")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.trim("line"))).alias("code"), F.max(F.when(F.col("i") % 2 == 1, F.trim("line"))).alias("value")
    )
    start = F.when(F.col("code") == "0", 1).otherwise(0)
    entity = F.sum(start).over(Window.partitionBy("file").orderBy("n"))
    rows = pairs.withColumn("entity", entity).where("entity > 0 and value is not null")
    first = lambda code: F.min_by(F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("n")))
    out = rows.groupBy("file", "entity").agg(*(first(k).alias(name) for k, name in (("0", "kind"), ("8", "layer"), ("10", "x"), ("20", "y"), ("40", "height"), ("1", "value"))))
    return out.select("file", "entity", "kind", "layer", *(F.col(n).try_cast("double").alias(n) for n in ("x", "y", "height")), "value")


def contents(registry: DataFrame, uploads: DataFrame, baseline: DataFrame) -> DataFrame:
    """``file, content`` of registered files; what was uploaded wins over the baseline."""
    up = uploads.select("file", F.col("content").alias("_up"))
    base = baseline.select("file", F.col("content").alias("_base"))
    return registry.select("file").distinct().join(up, "file", "left").join(base, "file", "left").select("file", F.coalesce("_up", "_base").alias("content")).where("content is not null")
