"""Queries on office files: every conversation as a workbook, a deck and a document, made by Spark and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources import documents as src
from kgspark.sources.tables import table

from .registry import query

c = F.col

_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _workbook(turns: list) -> dict[str, str]:
    """A header, a row per turn (number, role, text); the roles from the second on are one merged range."""
    rows = [("turn", "role", "text"), *turns]
    cell = lambda r, i, v: f'<c r="{"ABC"[i]}{r}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, i, v) for i, v in enumerate(row) if not (i == 1 and r > 3)) + "</row>" for r, row in enumerate(rows, 1))
    merged = f'<mergeCells><mergeCell ref="B3:B{len(rows)}"/></mergeCells>' if len(rows) > 3 else ""
    return {
        "xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="turns" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{body}</sheetData>{merged}</worksheet>",
    }


def _deck(turns: list) -> dict[str, str]:
    slide = lambda role, text: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{role}</a:t></a:r></a:p><a:p><a:t>{escape(text)}</a:t></a:p></p:sld>'
    return {f"ppt/slides/slide{n + 1}.xml": slide(role, text) for n, role, text in turns}


def _document(turns: list) -> dict[str, str]:
    return {"word/document.xml": '<w:d xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{role}: </w:t></w:r><w:r><w:t>{escape(text)}</w:t></w:r></w:p><w:p/>" for _, role, text in turns) + "</w:d>"}


_KINDS = {"xlsx": _workbook, "pptx": _deck, "docx": _document}


def files(spark, d, kind: str) -> DataFrame:
    """``file, content`` of one kind for every conversation; texts have their blanks squeezed, so that XML keeps them as they are."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Cntrl}]+", " "))
    turns = table(spark, d, "conversations").groupBy(c("conv_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct(c("turn").cast("int").alias("turn"), "role", text.alias("text")))).alias("t"))
    made = _KINDS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, part in made([(x["turn"], x["role"], x["text"]) for x in t]).items():
                        z.writestr(name, part)
                rows.append((f"{k}.{kind}", out.getvalue()))
            yield pd.DataFrame(rows, columns=["file", "content"])

    return turns.mapInPandas(run, "file string, content binary")


# turns in order, texts squeezed and in NFC as the readers give them
_TURNS = r"""with t as (select conv_id as k, turn, role, nfc_normalize(trim(regexp_replace(coalesce(text, ''), '[\s\x00-\x1F\x7F]+', ' ', 'g'))) as text, row_number() over (partition by conv_id order by turn, role, text) as n, count(*) over (partition by conv_id) as all_ from conversations)"""


@query()
def s3_directory_scan(spark, d) -> DataFrame:
    """The files under the tables' folder."""
    return src.scan(spark, d, "*.parquet").select("file", c("length").alias("bytes"))


@query(_TURNS + " select k || '.xlsx' as file, n as r, 'turn' as name, cast(turn as varchar) as value from t union all select k || '.xlsx', n, 'text', text from t where text <> '' union all select k || '.xlsx', n, 'role', role from t where n <= 2")
def s4_workbook_records(spark, d) -> DataFrame:
    """Rows of all workbooks under their headers."""
    return src.read_records(src.read_cells(files(spark, d, "xlsx"))).select("file", "r", "name", "value")


@query(_TURNS + ", f as (select k, role from t where n = 2) select t.k || '.xlsx' as file, n as r, 1 as c, case when n <= 2 then t.role else f.role end as value from t left join f on f.k = t.k union all select distinct k || '.xlsx', 0, 1, 'role' from t")
def s5_merged_grid(spark, d) -> DataFrame:
    """The column of roles with its merged range filled."""
    book = files(spark, d, "xlsx")
    return src.filled(src.read_cells(book), src.read_merges(book)).where("c = 1").select("file", "r", "c", "value")


@query(_TURNS + " select k || '.pptx' as file, turn + 1 as slide, 0 as line_no, role as text from t union all select k || '.pptx', turn + 1, 1, text from t where text <> ''")
def s6_slide_lines(spark, d) -> DataFrame:
    """Lines of all slides."""
    return src.read_slides(files(spark, d, "pptx")).select("file", "slide", "line_no", "text")


@query(_TURNS + " select k || '.docx' as file, n - 1 as line_no, trim(role || ': ' || text) as text from t")
def s7_paragraphs(spark, d) -> DataFrame:
    """Paragraphs of all documents."""
    return src.read_paragraphs(files(spark, d, "docx")).select("file", "line_no", "text")


_BLOCKS = _TURNS + """, sheet as (select k || '.xlsx' as file, 0 as block_no, 'turns' as label, n as i, case when n <= 2 then turn || ' │ ' || role || ' │ ' || text else turn || ' │  │ ' || text end as line from t union all select distinct k || '.xlsx', 0, 'turns', 0, 'turn │ role │ text' from t),
 slide as (select k || '.pptx' as file, turn as block_no, '슬라이드 ' || (turn + 1) as label, 0 as i, role as line from t union all select k || '.pptx', turn, '슬라이드 ' || (turn + 1), 1, text from t where text <> ''),
 doc as (select k || '.docx' as file, 0 as block_no, '본문' as label, n as i, trim(role || ': ' || text) as line from t),
 l as (select *, row_number() over (partition by file order by block_no, i) as place, count(*) over (partition by file) as total from (select * from sheet union all select * from slide union all select * from doc)),
 cut as (select file, block_no, label, list(line order by i) as lines, max(place) as last, max(total) as total from l where place <= 4 group by file, block_no, label)
 select file, block_no, label, case when total > 4 and last = 4 then list_append(lines, '… (이하 생략, 총 ' || total || '행)') else lines end as lines from cut"""


@query(_BLOCKS)
def s11_source_blocks(spark, d) -> DataFrame:
    """Blocks of all files, four lines of each file shown."""
    read = lambda kind, reader: reader(files(spark, d, kind))
    return src.source_blocks(read("xlsx", src.read_cells), read("pptx", src.read_slides), read("docx", src.read_paragraphs), 4).select("file", "block_no", "label", "lines")
