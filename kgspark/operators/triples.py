"""The graph and its schema as RDF triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import is_decimal

from .schema import Metamodel

RDF, RDFS, XSD = "rdf:", "rdfs:", "xsd:"


def uri(kind: str, name: Column) -> Column:
    """A percent-quoted name in one of the export's name spaces."""
    return F.concat(F.lit(f"{kind}:"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def triples(nodes: DataFrame, edges: DataFrame, model: Metamodel) -> DataFrame:
    """``subject, predicate, object``: the schema's classes, subclasses, relations and properties, then typed nodes, labels,
    properties with typed literals, and relations.

    Of several source or target types of a relation the first is its domain or range; a node is of its subtype's class only
    where that subtype is defined.
    """

    def rows(df: DataFrame, s: Column, p: Column | str, o: Column | str) -> DataFrame:
        return df.select(s.alias("subject"), (p if isinstance(p, Column) else F.lit(p)).alias("predicate"), (o if isinstance(o, Column) else F.lit(o)).alias("object"))

    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    kind = lambda *names: uri("class", F.concat_ws("_", *names))
    node, rel, prop = uri("node", F.col("id")), uri("rel", F.col("rel_id")), uri("prop", F.col("key"))
    types, rels, subs, defs = model.object_types, model.relation_types, model.subtypes, model.property_defs
    told = lambda df, s: rows(df.where("label is not null"), s, RDFS + "label", quoted(F.col("label")))
    number = F.when(F.col("datatype") == "number", XSD + "decimal").otherwise(XSD + "string")
    defined = subs.select("canvas_id", F.col("type_id").alias("type"), F.col("st_id").alias("st")).distinct().withColumn("_sub", F.lit(True))
    typed = nodes.where("type is not null").join(defined, ["canvas_id", "type", "st"], "left")
    props = nodes.select("id", F.explode("props").alias("p")).select("id", "p.k", "p.v")
    literal = F.concat(quoted(F.col("v")), F.when(is_decimal(F.trim("v")), F.lit("^^xsd:decimal")).otherwise(""))
    parts = [
        rows(types, kind("type_id"), RDF + "type", RDFS + "Class"),
        told(types, kind("type_id")),
        rows(types.where("description <> ''"), kind("type_id"), RDFS + "comment", quoted(F.col("description"))),
        rows(subs, kind("type_id", "st_id"), RDF + "type", RDFS + "Class"),
        rows(subs, kind("type_id", "st_id"), RDFS + "subClassOf", kind("type_id")),
        told(subs, kind("type_id", "st_id")),
        rows(rels, rel, RDF + "type", RDF + "Property"),
        told(rels, rel),
        rows(rels.where("size(src_types) > 0"), rel, RDFS + "domain", kind(F.col("src_types")[0])),
        rows(rels.where("size(dst_types) > 0"), rel, RDFS + "range", kind(F.col("dst_types")[0])),
        rows(defs, prop, RDF + "type", RDF + "Property"),
        rows(defs, prop, RDFS + "domain", kind("type_id")),
        rows(defs, prop, RDFS + "range", number),
        told(defs, prop),
        rows(typed, node, RDF + "type", F.when(F.col("_sub"), kind("type", "st")).otherwise(kind("type"))),
        told(nodes, node),
        rows(props, node, uri("prop", F.col("k")), literal),
        rows(edges, uri("node", F.col("src")), uri("rel", F.col("rel")), uri("node", F.col("dst"))),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def write_n_triples(found: DataFrame, path: str) -> None:
    """One line per triple, as text files."""
    found.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("value")).write.text(path)
