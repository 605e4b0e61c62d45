"""Readers and streams on small files."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kgspark.operators import ingest, search
from kgspark.sources import documents as src
from kgspark.streaming import changes

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    rows = [["Title"], ["part name", "failure mode", "S"], ["lamp", "fog", "8"], ["", "crack", "3 EA"]]
    cells = "".join(
        f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + i)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows)
    )
    return packed(
        {
            "xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="fmea" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>',
        }
    )


@pytest.fixture
def files(spark, tmp_path):
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p/></p:sld>'
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.pptx").write_bytes(packed({f"ppt/slides/slide{i}.xml": slide(f"s{i}") for i in (1, 2, 10)}))
    (tmp_path / "c.docx").write_bytes(packed({"word/document.xml": '<w:d xmlns:w="w"><w:p><w:r><w:t>Part: </w:t></w:r><w:r><w:t>lamp</w:t></w:r></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Cause: heat</w:t></w:p></w:d>'}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip file")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    return lambda pattern: src.scan(spark, str(tmp_path), pattern)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scan_skips_locks(files):
    assert rows(files("*.xlsx"), "file") == [("a.xlsx",), ("broken.xlsx",)]


def test_workbooks(files):
    cells = src.read_cells(files("*.xlsx"))
    assert rows(cells.where("error is not null"), "file") == [("broken.xlsx",)]
    assert (("a.xlsx", "fmea", 2, 0, "lamp")) in rows(cells.where("error is null"), "file", "sheet", "r", "c", "value")
    merges = src.read_merges(files("*.xlsx"))
    assert rows(merges.where("error is null"), "r1", "c1", "r2", "c2") == [(2, 0, 3, 0)]
    full = src.filled(cells, merges)
    assert ("lamp",) in rows(full.where("r = 3 and c = 0"), "value")
    records = src.read_records(full.where("r > 0").withColumn("error", F.lit(None).cast("string")))
    assert rows(records.where("r = 3"), "name", "value") == [("S", "3 EA"), ("failure mode", "crack"), ("part name", "lamp")]


def test_header_detection_on_a_workbook(spark, files):
    synonyms = spark.createDataFrame([("item", "part name"), ("fm", "failure mode"), ("s", "S")], "role string, synonym string")
    found = ingest.detected_header(src.read_cells(files("a.xlsx")), synonyms)
    assert rows(found, "row", "span", "roles") == [(1, 1, ["fm", "item", "s"])]


def test_slides_in_order(files):
    assert [r["text"] for r in src.read_slides(files("*.pptx")).orderBy("slide").collect()] == ["s1", "s2", "s10"]


def test_paragraphs(files):
    assert rows(src.read_paragraphs(files("*.docx")), "line_no", "text") == [(0, "Part: lamp"), (1, "Cause: heat")]


def test_mails(spark):
    html = base64.b64encode("<p>Gr&amp;ü<b>n</b></p>".encode()).decode()
    raw = [
        ("plain", b"From: a@b.c\r\nSubject: =?utf-8?B?w7xiZXI=?=\r\n\tmore\r\n\r\nhello\r\n"),
        ("quoted", b"Subject: q\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\na=C3=BCb=\r\nc"),
        ("html", f"Subject: h\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n{html}\r\n".encode()),
        ("garbage", b"\x00\xff\xfe no header at all"),
    ]
    found = src.read_mails(spark.createDataFrame(raw, "file string, content binary"))
    got = {r["file"]: (r["subject"], r["body"]) for r in found.collect()}
    assert got["plain"] == ("über more", "hello") and got["quoted"] == ("q", "aübc") and got["html"] == ("h", "Gr&ü n")
    assert "garbage" in got


def test_drawings(spark):
    text = "0\nSECTION\n0\nTEXT\n8\nnotes\n10\n1.5\n20\n2\n1\nPC\n1\nlater\n0\nLINE\n10\nx"
    found = src.drawing_entities(spark.createDataFrame([("d.dxf", text)], "file string, text string"))
    assert rows(found.where("kind = 'TEXT'"), "layer", "x", "y", "value") == [("notes", 1.5, 2.0, "PC")]
    assert rows(found.where("kind = 'LINE'"), "x") == [(None,)]


def test_entity_scan_is_the_same_with_a_large_vocabulary(spark):
    vocabulary = spark.createDataFrame([("v1", "head lamp", ["lamp"]), ("v2", "vent", []), ("v3", "x", [])], "id string, label string, synonyms array<string>")
    texts = spark.createDataFrame([(1, "The HeadLamp fogs"), (2, "a ven t"), (3, ""), (4, None)], "doc int, text string")
    small, large = ingest.scan_entities(texts, vocabulary), ingest.scan_entities(texts, vocabulary, part=3)
    assert rows(small, "doc", "id") == rows(large, "doc", "id") == [(1, "v1"), (2, "v2")]


def test_first_wins_stream(spark, tmp_path):
    schema = "id string, v int, at timestamp"
    for i, part in enumerate([[("a", 1, "2024-01-01 00:00:00"), ("b", 2, "2024-01-01 00:00:01")], [("a", 3, "2024-01-01 00:00:30"), ("c", 4, "2024-01-01 00:01:00")]]):
        spark.createDataFrame(part, "id string, v int, t string").select("id", "v", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = changes.first_wins(stream, ["id"], "at", "1 hour")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert len(rows(spark.read.parquet(str(tmp_path / "out")), "id")) == 3


def test_first_wins_after_a_restart_with_late_rows_and_expiry(spark, tmp_path):
    def come(i, *found):
        spark.createDataFrame(found, "id string, t string").select("id", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema("id string, at timestamp").parquet(str(tmp_path / "in*"))
        out = changes.first_wins(stream, ["id"], "at", "1 hour")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return [r[0] for r in rows(spark.read.parquet(str(tmp_path / "out")), "id")]

    assert come(0, ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01")) == ["a"]
    assert come(1, ("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 05:00:00")) == ["a", "b"]  # a is remembered over the restart
    assert come(2, ("c", "2024-01-01 01:00:00")) == ["a", "b"]  # later than the watermark allows
    assert come(3, ("a", "2024-01-01 05:30:00")) == ["a", "a", "b"]  # forgotten meanwhile


def test_merged_stream_is_idempotent(spark, tmp_path):
    table = changes.NodeTable(spark, str(tmp_path / "nodes"), "canvas_id string, id string, label string, ord long")
    batch = lambda *r: spark.createDataFrame([("m", *x) for x in r], "canvas_id string, id string, label string, ord long")
    merge = table.merge()
    merge(batch(("a", "one", 2), ("a", "zero", 1)), 0)
    merge(batch(("a", "two", 3), ("b", "three", 4)), 1)
    merge(batch(("a", "two", 3), ("b", "three", 4)), 1)
    assert rows(table.read(), "id", "label") == [("a", "zero"), ("b", "three")]


def test_merged_stream_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    table = changes.NodeTable(spark, str(tmp_path / "nodes"), "canvas_id string, id string, label string, ord long", buckets=16)
    batch = lambda *r: spark.createDataFrame([("m", *x) for x in r], "canvas_id string, id string, label string, ord long")
    files = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "nodes").rglob("part-*")}
    merge = table.merge()
    merge(batch(*((f"k{i}", "old", i) for i in range(60))), 0)
    before = files()
    second = batch(("k3", "new", 1), ("z1", "new", 2))
    merge(second, 1)
    after = files()
    assert before.items() <= after.items() and len({f.split("/")[1] for f in after.keys() - before.keys()}) == 1
    once = rows(table.read(), "id", "label", "batch_id")
    merge(second, 1)
    assert rows(table.read(), "id", "label", "batch_id") == once and len(once) == 61


def test_centroid_index_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 100 = 0").withColumnRenamed("id", "qid")
    exact = {tuple(r) for r in search.nearest(asked, v, 8).select("qid", "id").collect()}
    found = {tuple(r) for r in search.nearest(asked, v, 8, exact=False, first=24, ring=32).select("qid", "id").collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_nearest_is_exact(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "id int, embedding array<float>")
    found = search.nearest(v.where("id < 2").withColumnRenamed("id", "qid"), v, 2)
    assert rows(found, "qid", "id", "place") == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1)]
