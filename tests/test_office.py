"""Links out of decks, reports and answers on odd rows."""

from kgspark.operators import office

ANSWER = "doc long, entities array<struct<type:string,id:string,label:string>>, relations array<struct<srcLabel:string,rel:string,dstLabel:string>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_deck_takes_the_first_of_each(spark):
    lines = [(1, 0, 0, "cover"), (1, 0, 1, None), (1, 0, 2, "part: "), (1, 0, 3, "part: Lamp"), (1, 1, 0, "issue: fog"), (1, 2, 0, "causes"), (1, 2, 1, "seal"), (1, 2, 2, "seal"), (1, 2, 3, None), (2, 0, 0, "issue: fog"), (2, 1, 0, "actions"), (2, 1, 1, " ")]
    found = office.deck_links(spark.createDataFrame(lines, "doc long, slide int, line int, text string"), "part:", "issue:", "causes", "actions")
    # the first line with the prefix is blank, so the deck names no part
    assert rows(found) == [(1, "fog", "CAUSED_BY", "seal")]


def test_report_takes_the_last_of_each(spark):
    lines = [(1, 0, "part: A"), (1, 1, "part: B"), (1, 2, "mode: M"), (1, 3, None), (2, 0, "cause: C"), (2, 1, "action: X: Y"), (3, 0, "mode: M"), (3, 1, "mode:")]
    found = office.report_links(spark.createDataFrame(lines, "doc long, pos int, text string"), {"item": "part", "fm": "mode", "cause": "cause", "action": "action"})
    assert rows(found) == [(1, "B", "HAS_FAILURE", "M"), (2, "C", "MITIGATED_BY", "X: Y")]


def test_delta_invents_nothing(spark):
    known = spark.createDataFrame([("N1", "item", "Lamp unit", 1), ("D1", "doc", "Fog", 2)], "id string, type string, label string, ord long")
    entities = [("item", "N1", "other name"), ("item", "X9", "lamp-unit"), ("fm", None, "Fog"), ("fm", None, None), ("bad", None, "Z")]
    relations = [("Other  Name", "R", "FOG"), ("Fog", "R", "nothing"), ("Fog", "S", "Lamp unit"), ("Lamp unit", "R", "other name"), (None, "R", "Fog")]
    nodes, edges = office.extraction_delta(spark.createDataFrame([(7, entities, relations), (8, None, None)], ANSWER), known, ["item", "fm"], ["R"])
    (new,) = [r["id"] for r in nodes.where("new").collect()]
    assert rows(nodes.select("doc", "id", "type", "label", "new")) == sorted([(7, "N1", "item", "Lamp unit", False), (7, new, "fm", "Fog", True)])
    assert rows(edges) == sorted([(7, "N1", "R", new), (7, new, "EVIDENCED_BY", "7")])


def test_empty_tables(spark):
    nodes, edges = office.extraction_delta(spark.createDataFrame([], ANSWER), spark.createDataFrame([], "id string, type string, label string, ord long"), ["item"], ["R"])
    assert rows(nodes) == rows(edges) == []
    assert rows(office.extraction_summary(spark.createDataFrame([], "file string, src string, dst string"))) == []
    cells = spark.createDataFrame([], "file string, sheet string, r long, c int, value string")
    assert rows(office.worksheet_rows(cells, spark.createDataFrame([("item", "part", 0)], "role string, synonym string, ord int"), ("item", "fm"))) == []
