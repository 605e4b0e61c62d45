"""Invariants of the graph operators on tiny graphs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.functions import domain, text
from kgspark.operators import chunks, components, graph, ingest, merge, quality

NODE = "canvas_id string, id string, type string, label string, sub string, st string, props array<struct<k:string,v:string>>, ord long"
EDGE = "canvas_id string, src string, rel string, dst string, weight double, ord long"


def nodes(spark, *rows, canvas="a"):
    return spark.createDataFrame([(canvas, i, t, label, None, None, [], n) for n, (i, t, label) in enumerate(rows)], NODE)


def edges(spark, *rows, canvas="a"):
    return spark.createDataFrame([(canvas, *r[:3], r[3] if len(r) > 3 else None, n) for n, r in enumerate(rows)], EDGE)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_canvases_stay_apart(spark):
    n = nodes(spark, ("x", "item", "X"), ("y", "fm", "Y")).unionByName(nodes(spark, ("x", "item", "other"), canvas="b"))
    e = edges(spark, ("x", "HAS_FAILURE", "y")).unionByName(edges(spark, ("x", "HAS_FAILURE", "y"), canvas="b"))
    assert rows(graph.intact(n, e), "canvas_id") == [("a",)]
    anchors = n.select("canvas_id", F.col("id").alias("anchor"))
    assert rows(graph.follow(anchors, n, e, ["HAS_FAILURE"]), "canvas_id", "anchor", "id") == [("a", "x", "y")]


def test_merge_is_idempotent_and_first_wins(spark):
    n, e = nodes(spark, ("x", "item", "X")), edges(spark)
    new = nodes(spark, ("x", "item", "new"), ("y", "fm", "Y"), ("y", "fm", "again"))
    links = edges(spark, ("x", "R", "y"), ("x", "R", "y"), ("x", "R", "nowhere"))
    delta = merge.merge_delta(n, e, new, links)
    assert rows(delta.nodes, "id", "label") == [("y", "Y")]
    assert rows(delta.edges, "src", "dst") == [("x", "y")] and rows(delta.touched, "id") == [("x",)]
    again = merge.merge_delta(n.unionByName(delta.nodes), e.unionByName(delta.edges), new, links)
    assert again.nodes.count() == again.edges.count() == again.touched.count() == 0


def test_merge_keeps_lost_labels_and_drops_loops(spark):
    n = nodes(spark, ("x", "item", "X"), ("y", "item", "Y"), ("z", "fm", "Z"))
    e = edges(spark, ("x", "R", "y"), ("y", "R", "z"), ("x", "R", "z"))
    left, links = merge.merge_nodes(n, e, spark.createDataFrame([("a", "y", "x")], "canvas_id string, id string, into string"), "merged")
    assert rows(left, "id") == [("x",), ("z",)] and rows(links, "src", "rel", "dst") == [("x", "R", "z")]
    assert left.where("id = 'x'").first()["props"][0]["v"] == "Y"


def test_shared_objects_survive_a_deleted_document(spark):
    n = nodes(spark, ("d1", "doc", "1"), ("d2", "doc", "2"), ("x", "item", "X"), ("y", "item", "Y"))
    e = edges(spark, ("x", "EVIDENCED_BY", "d1"), ("y", "EVIDENCED_BY", "d1"), ("y", "EVIDENCED_BY", "d2"))
    left, links, fate = merge.delete_documents(n, e, n.where("id = 'd1'"))
    assert rows(left, "id") == [("d2",), ("y",)] and rows(links, "src", "dst") == [("y", "d2")] and rows(fate, "id", "fate") == [("x", "gone"), ("y", "kept")]


def test_derived_ways_are_real_and_simple(spark):
    e = edges(spark, ("a", "CONSISTS_OF", "b"), ("b", "CONSISTS_OF", "c"), ("c", "CONSISTS_OF", "a"), ("c", "CONSISTS_OF", "d"), ("a", "CONSISTS_OF", "d"))
    real = {(r[0], r[1]) for r in rows(e, "src", "dst")}
    for r in graph.transitive(e).collect():
        path = [r["src"], *r["via"], r["dst"]]
        assert len(set(path)) == len(path) and (r["src"], r["dst"]) not in real
        assert all(step in real for step in zip(path, path[1:]))


def test_audits_on_a_small_graph(spark):
    n = nodes(spark, ("AUTO_1", "item", "Head-Lamp"), ("l", "item", "head lamp"), ("lone", "item", "Lone"), ("d", "doc", "f"))
    e = edges(spark, ("AUTO_1", "EVIDENCED_BY", "d"), ("lone", "EVIDENCED_BY", "d"), ("l", "R", "AUTO_1"))
    assert rows(quality.auto_duplicates(n, e), "id", "other", "confidence") == [("AUTO_1", "l", 92)]
    assert rows(quality.orphans(n, e), "id") == [("lone",)]
    assert rows(quality.without_evidence(n, e), "id") == [("l",)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, links):
    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        one, other = sorted((root(a), root(b)))
        parent[other] = one
    found = components.components(spark.createDataFrame(links, "a int, b int"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in range(13) if root(x) != x}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab ", max_size=14), max_size=12))
def test_prose_chunks_equal_a_plain_loop(spark, lines):
    paras = [x.strip(" ") for x in lines if x.strip(" ")]
    out, cur, size = [], [], 0
    for p in paras:
        if cur and size + len(p) + 1 > 20:
            out.append("\n".join(cur))
            cur, size = [cur[-1]], len(cur[-1])
        cur.append(p)
        size += len(p) + 1
    if cur:
        out.append("\n".join(cur))
    found = spark.createDataFrame([(lines,)], "lines array<string>").select(chunks.prose(F.col("lines"), 20).alias("c")).first()["c"]
    assert found == out


@pytest.mark.parametrize("value, expected", [("", "811c9dc5"), ("a", "e40c292c"), ("foobar", "bf9cf968")])
def test_fnv1a(spark, value, expected):
    assert spark.range(1).select(text.fnv1a(F.lit(value)).alias("h")).first()["h"] == expected


@pytest.mark.parametrize("name, expected", [("pc", 65), ("PC+ABS GF", 75), ("sheet of PC", 65), ("steel", None), (None, None)])
def test_expansion(spark, name, expected):
    assert spark.range(1).select(domain.expansion(F.lit(name).cast("string")).alias("e")).first()["e"] == expected


def test_confidence_terms_add_up(spark):
    f = domain.confidence(F.lit(1.4), F.lit(30), F.lit(10), F.lit(True), F.lit(0.5))
    r = spark.range(1).select(f.alias("f")).first()["f"]
    assert r["confidence"] == 100 and abs(r["sim"] + r["evid"] + r["sev"] + r["master"] + r["boost"] - 1) < 1e-9


def test_extraction_binds_labels(spark):
    record = [(1, [("item", "Lamp"), ("item", " "), ("fm", "Fog")], [("LAMP", "HAS", "fog"), ("lamp", "HAS", "none"), ("fog", "IS", "Fog")])]
    frame = spark.createDataFrame(record, "doc int, entities array<struct<type:string,label:string>>, relations array<struct<srcLabel:string,rel:string,dstLabel:string>>")
    found, links = ingest.extraction_to_graph(frame)
    assert [r[0] for r in rows(found, "label")] == ["Fog", "Lamp"] and [r[0] for r in rows(links, "rel")] == ["HAS"]
