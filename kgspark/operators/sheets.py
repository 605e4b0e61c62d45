"""Reference sheets and parts lists into properties and relations.

Rows of sheets are ``file, sheet, row, cells`` with a map from header to text.  What a sheet means is told by rules, not by code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import fold

from .graph import first_per_key
from .ingest import matched_columns


@dataclass(frozen=True)
class Link:
    """A relation of each row: columns of its ends, a fixed name or a column of names (with a default), a weight, a mark of scenarios.

    ``split`` makes one relation for each item of a comma list in the source column.
    """

    src: str
    dst: str
    rel: str = ""
    rel_column: str = ""
    split: bool = False
    weight: str = ""
    scenario: str = ""
    always: bool = False


@dataclass(frozen=True)
class Rule:
    """What the rows of one sheet of files with a prefix bring: properties (key, column), numbered ones, a subtitle, marks, relations."""

    prefix: str
    sheet: str
    key: str = ""
    props: tuple[tuple[str, str], ...] = ()
    numbered: str = ""
    sub: str = ""
    marks: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n) for n in names)


# The reference sheets.
RULES = (
    Rule("법규기준", "법규", "id", _same("국가", "핵심", "비고")),
    Rule("법규기준", "법규적용", links=(Link("대상id", "reg_id", rel_column="관계"),)),
    Rule("설계표준", "마스터", "id", _same("성격", "항목"), numbered="항목", sub="sub", links=(Link("참조원id", "id", "REF_MASTER", "관계"),)),
    Rule("고객사", "스펙", "id", _same("고객사", "포함"), sub="sub", links=(Link("적용프로젝트", "id", "SPEC_OF", split=True),)),
    Rule("유사도매트릭스", "프로젝트", "id", (*_same("차종", "광원"), ("이슈 이력", "이슈이력"), *_same("비고", "상태", "조건")), sub="요약", marks=("hidden",)),
    Rule("유사도매트릭스", "부품", "id", _same("구성", "특성", "소재", "리스크"), sub="요약", marks=("hero",)),
    Rule("유사도매트릭스", "구성", links=(Link("상위id", "하위id", rel_column="관계"),)),
    Rule("유사도매트릭스", "유사도", links=(Link("from_id", "to_id", "SIMILAR", weight="weight", scenario="scenario"),)),
    Rule("유사도매트릭스", "시나리오", links=(Link("from_id", "to_id", rel_column="관계", always=True),)),
    Rule(
        "유사도매트릭스", "형상특징", "id",
        (("시장", "시장"), ("형상.하우징", "하우징"), ("형상.벤트 홀", "벤트홀"), ("형상.실링", "실링"), ("형상.개스킷 소재", "개스킷소재"), ("형상.커넥터", "커넥터"), ("형상.렌즈", "렌즈")),
    ),
)
# Names of the columns of a parts list.
PARTS = {"parent": ("상위부품", "상위 부품", "모듈", "assembly", "parent"), "child": ("부품명", "품명", "부품", "part"), "qty": ("수량", "qty", "quantity"), "material": ("재질", "소재", "material")}


def _cell(name: str) -> Column:
    return F.nullif(F.trim(F.col("cells")[name]), F.lit(""))


def _rows(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.where(F.col("file").startswith(rule.prefix) & (F.col("sheet") == rule.sheet))


def sheet_props(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id, k, v``: properties from all sheets, the subtitle as ``sub`` and marks as ``hidden`` or ``hero`` among them; the first value of a key counts."""
    parts = []
    for rank, rule in enumerate(r for r in rules if r.key):
        own = _rows(rows, rule).select(_cell(rule.key).alias("id"), "file", "row", "cells").where("id is not null")
        pairs = [F.struct(F.lit(k).alias("k"), _cell(column).alias("v")) for k, column in rule.props]
        if rule.sub:
            pairs.append(F.struct(F.lit("sub").alias("k"), _cell(rule.sub).alias("v")))
        pairs += [F.struct(F.lit(m).alias("k"), F.when(_cell(m) == "Y", "Y").alias("v")) for m in rule.marks]
        every = F.array(*pairs)
        if rule.numbered:
            more = F.filter(F.map_entries("cells"), lambda e: e["key"].rlike(f"^{rule.numbered}[0-9]+$"))
            every = F.concat(every, F.transform(more, lambda e: F.struct(e["key"].alias("k"), F.nullif(F.trim(e["value"]), F.lit("")).alias("v"))))
        each = own.select("id", F.struct(F.lit(rank).alias("rule"), "file", "row").alias("ord"), F.posexplode(every).alias("i", "p"))
        parts.append(each.select("id", "ord", "i", "p.k", "p.v").where("v is not null"))
    said = _mentions(rows)
    found = reduce(DataFrame.unionByName, parts).unionByName(said)
    return first_per_key(found, ["id", "k"], "ord", "i").select("id", "k", "v")


def _mentions(rows: DataFrame) -> DataFrame:
    """What users say about projects, as properties of these."""
    own = _rows(rows, Rule("소비자반응", "언급")).where(_cell("프로젝트").isNotNull())
    place = F.concat_ws(" · ", F.concat_ws("·", _cell("지역"), _cell("계절")), _cell("출처"), _cell("URL"))
    value = F.concat(_cell("언급수"), F.lit("건 ("), place, F.lit(")"))
    return own.select(_cell("프로젝트").alias("id"), F.struct(F.lit(1000).alias("rule"), "file", "row").alias("ord"), F.lit(0).alias("i"), F.concat(F.lit("소비자언급."), _cell("증상")).alias("k"), value.alias("v"))


def sheet_edges(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``src, rel, dst, weight, scen``: relations from all sheets; an empty weight is none, not 0; of equal relations the first counts."""
    parts = []
    for rank, rule in enumerate(rules):
        for link in rule.links:
            rel = F.coalesce(*([_cell(link.rel_column)] if link.rel_column else []), F.nullif(F.lit(link.rel), F.lit("")))
            source = F.explode(F.split(_cell(link.src), ",")) if link.split else _cell(link.src)
            weight = _cell(link.weight).try_cast("double") if link.weight else F.lit(None).cast("double")
            scen = F.lit(True) if link.always else F.coalesce(_cell(link.scenario) == "Y", F.lit(False)) if link.scenario else F.lit(False)
            one = _rows(rows, rule).select(F.struct(F.lit(rank).alias("rule"), "file", "row").alias("ord"), source.alias("src"), rel.alias("rel"), _cell(link.dst).alias("dst"), weight.alias("weight"), scen.alias("scen"))
            parts.append(one.withColumn("src", F.nullif(F.trim("src"), F.lit(""))).where("src is not null and dst is not null and rel is not null"))
    return first_per_key(reduce(DataFrame.unionByName, parts), ["src", "rel", "dst"], "ord").select("src", "rel", "dst", "weight", "scen")


def parts_columns(headers: DataFrame) -> DataFrame:
    """``file, sheet, parent, child, qty, material``: the columns of a parts list among headers (file, sheet, c, name).

    An equal name goes before one that holds a known name, and the parent's column is no candidate for the part.  Sheets without a column
    of parts are left out.
    """
    spark = headers.sparkSession
    words = lambda role: spark.createDataFrame([(role, w, i) for i, w in enumerate(PARTS[role])], "role string, synonym string, ord int")
    keyed = headers.withColumn("file", F.struct("file", "sheet"))
    find = lambda df, role: _first_column(df, words(role)).select("file", F.col("name").alias(role))
    parent = find(keyed, "parent")
    rest = keyed.join(parent.select("file", F.col("parent").alias("name")), ["file", "name"], "left_anti")
    rows = find(rest, "child").join(parent, "file", "left").join(find(keyed, "qty"), "file", "left").join(find(keyed, "material"), "file", "left")
    return rows.select("file.file", "file.sheet", "parent", "child", "qty", "material")


def _first_column(headers: DataFrame, words: DataFrame) -> DataFrame:
    """Of the headers that equal a word the first, else the first that holds one; ``matched_columns`` with columns before words."""
    return matched_columns(headers, words.withColumn("ord", F.lit(0)))


def parts_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties (name, k, v) of parts and edges (src, rel, dst) from assemblies to parts, out of all sheets that are parts lists.

    Rows without a part are left out; a row without an assembly gives properties only.  Names are to be resolved to ids afterwards.
    """
    first = first_per_key(rows, ["file", "sheet"], "row").select("file", "sheet", F.posexplode(F.map_keys("cells")).alias("c", "name"))
    own = rows.join(parts_columns(first), ["file", "sheet"])
    value = lambda column: F.nullif(F.trim(F.element_at("cells", F.col(column))), F.lit(""))
    own = own.select("file", "sheet", "row", *(F.when(F.col(n).isNotNull(), value(n)).alias(n) for n in PARTS)).where("child is not null")
    pairs = F.array(F.struct(F.lit("수량").alias("k"), F.col("qty").alias("v")), F.struct(F.lit("재질").alias("k"), F.col("material").alias("v")))
    each = own.select(F.col("child").alias("name"), F.struct("file", "sheet", "row").alias("ord"), F.explode(pairs).alias("p")).select("name", "ord", "p.*").where("v is not null")
    props = first_per_key(each.withColumn("key", fold(F.col("name"))), ["key", "k"], "ord").select("name", "k", "v")
    edges = own.where("parent is not null").select(F.col("parent").alias("src"), F.lit("CONSISTS_OF").alias("rel"), F.col("child").alias("dst"))
    return props, edges.distinct()
