"""Queries on reference sheets and parts lists; the star schema stands for the sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import sheets as sh
from kgspark.sources.tables import table

from .registry import query

c = F.col


def _sheet(df: DataFrame, file: str, name: str, row: str, **cells) -> DataFrame:
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in cells)), F.array(*((v if not isinstance(v, str) else F.lit(v)).cast("string") for v in cells.values())))
    return df.select(F.lit(file).alias("file"), F.lit(name).alias("sheet"), c(row).cast("long").alias("row"), pairs.alias("cells"))


def rows(spark, d) -> DataFrame:
    """Sheets of all kinds, and one of a file that is no reference file."""
    t = lambda name: table(spark, d, name)
    cat = lambda *parts: F.concat(*(F.lit(p) if p.isupper() or not p[0].islower() else c(p).cast("string") for p in parts))
    k, s = c("c_custkey"), c("s_suppkey")
    blank = lambda cond, value: F.when(cond, value).otherwise(" ")
    parts = [
        _sheet(t("region"), "법규기준1", "법규", "r_regionkey", id=cat("R", "r_regionkey"), 국가=c("r_name"), 핵심=" ", 비고="b"),
        _sheet(t("customer"), "법규기준1", "법규적용", "c_custkey", 대상id=cat("PJ", "c_custkey"), reg_id=F.concat(F.lit("R"), k % 5), 관계=blank(k % 6 != 0, F.lit("UNDER_REG"))),
        _sheet(t("nation"), "설계표준", "마스터", "n_nationkey", id=cat("M", "n_nationkey"), sub=c("n_name"), 성격="x", 항목="a·b", 항목1=c("n_name"), 항목12=blank(c("n_nationkey") % 2 == 0, F.lit("more")), 참조원id=F.concat(F.lit("C"), c("n_nationkey") % 3), 관계=blank(c("n_nationkey") % 4 == 0, F.lit("MUST"))),
        _sheet(t("nation"), "고객사A", "스펙", "n_nationkey", id=cat("SP", "n_nationkey"), 고객사=c("n_name"), 적용프로젝트=F.concat(F.lit("PJ1, PJ"), c("n_nationkey"), F.lit(" ,"))),
        _sheet(t("customer"), "유사도매트릭스", "프로젝트", "c_custkey", id=cat("PJ", "c_custkey"), 요약=blank(k % 2 == 0, c("c_name")), hidden=F.when(k % 7 == 0, "Y").otherwise("N"), 차종=c("c_mktsegment"), 이슈이력=blank(k % 3 == 0, F.lit("had"))),
        _sheet(t("customer"), "유사도매트릭스", "유사도", "c_custkey", from_id=cat("PJ", "c_custkey"), to_id=F.concat(F.lit("PJ"), k % 11), weight=blank(k % 3 != 0, F.concat(F.lit("0."), k % 9)), scenario=F.when(k % 4 == 0, "Y").otherwise("")),
        _sheet(t("supplier"), "유사도매트릭스", "시나리오", "s_suppkey", from_id=cat("IS", "s_suppkey"), to_id="FX", 관계="LEADS_TO"),
        _sheet(t("supplier"), "유사도매트릭스", "형상특징", "s_suppkey", id=F.concat(F.lit("PJ"), s), 시장="m", 벤트홀=F.concat(s % 3, F.lit(" (up)"))),
        _sheet(t("customer"), "소비자반응2", "언급", "c_custkey", 프로젝트=blank(k % 5 == 0, cat("PJ", "c_custkey")), 증상="fog", 언급수=k % 20, 지역="asia", 계절="rain", 출처="forum", URL=" "),
        _sheet(t("customer"), "other", "프로젝트", "c_custkey", id=cat("ZZ", "c_custkey"), 차종="no"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    """with cu as (select c_custkey as k, * from customer), na as (select n_nationkey as k, * from nation)
    select 'R' || r_regionkey as id, '국가' as k, r_name as v from region union all select 'R' || r_regionkey, '비고', 'b' from region
    union all select 'M' || k, unnest(['sub', '성격', '항목', '항목1']), unnest([n_name, 'x', 'a·b', n_name]) from na union all select 'M' || k, '항목12', 'more' from na where k % 2 = 0 union all select 'SP' || k, '고객사', n_name from na
    union all select 'PJ' || k, 'sub', c_name from cu where k % 2 = 0 union all select 'PJ' || k, 'hidden', 'Y' from cu where k % 7 = 0 union all select 'PJ' || k, '차종', c_mktsegment from cu union all select 'PJ' || k, '이슈 이력', 'had' from cu where k % 3 = 0
    union all select 'PJ' || s_suppkey, unnest(['시장', '형상.벤트 홀']), unnest(['m', s_suppkey % 3 || ' (up)']) from supplier
    union all select 'PJ' || k, '소비자언급.fog', k % 20 || '건 (asia·rain · forum)' from cu where k % 5 = 0"""
)
def i6_reference_sheets(spark, d) -> DataFrame:
    """Properties from sheets of all kinds."""
    return sh.sheet_props(rows(spark, d))


@query(
    """with cu as (select c_custkey as k from customer), na as (select n_nationkey as k from nation), none as (select cast(null as double) as w)
    select 'PJ' || k as src, 'UNDER_REG' as rel, 'R' || k % 5 as dst, w as weight, false as scen from cu, none where k % 6 <> 0
    union all select 'C' || k % 3, case when k % 4 = 0 then 'MUST' else 'REF_MASTER' end, 'M' || k, w, false from na, none
    union all select distinct src, 'SPEC_OF', 'SP' || k, w, false from (select k, unnest(['PJ1', 'PJ' || k]) as src from na), none
    union all select 'PJ' || k, 'SIMILAR', 'PJ' || k % 11, case when k % 3 <> 0 then cast('0.' || k % 9 as double) end, k % 4 = 0 from cu
    union all select 'IS' || s_suppkey, 'LEADS_TO', 'FX', w, true from supplier, none"""
)
def i6_reference_edges(spark, d) -> DataFrame:
    """Relations from sheets of all kinds."""
    return sh.sheet_edges(rows(spark, d))


def lists(spark, d) -> DataFrame:
    """Parts lists under two sets of headers, and a sheet without parts."""
    lines, k = table(spark, d, "lineitem"), c("l_orderkey")
    row = (c("l_linenumber") * 1_000_000 + c("l_partkey")).alias("row")
    cell = lambda name, value: (F.lit(name), value.cast("string"))

    def sheet(df, name, *cells):
        return df.select(F.concat(F.lit("BOM"), k).alias("file"), F.lit(name).alias("sheet"), row, F.map_from_arrays(F.array(*(n for n, _ in cells)), F.array(*(v for _, v in cells))).alias("cells"))

    up = F.when(c("l_linenumber") > 1, F.concat(F.lit("S"), "l_suppkey")).otherwise(" ")
    one = sheet(lines.where(k % 2 == 0), "a", cell("레벨", F.lit(1)), cell("상위 부품", up), cell("부품명", F.concat(F.lit("P"), "l_partkey")), cell("수량", F.floor("l_quantity")), cell("재질", c("l_returnflag")))
    two = sheet(lines.where(k % 2 == 1), "b", cell("Parent Assembly", up), cell("qty ", F.floor("l_quantity")), cell("Part No", F.concat(F.lit("P"), "l_partkey")))
    return one.unionByName(two).unionByName(sheet(lines.where(k % 5 == 0), "c", cell("수량", F.lit(1)), cell("note", F.lit("x"))))


_LINES = "with l as (select l_orderkey as k, l_linenumber as n, l_linenumber * 1000000 + l_partkey as row, 'S' || l_suppkey as up, 'P' || l_partkey as part, cast(cast(floor(l_quantity) as bigint) as varchar) as qty, l_returnflag as mat from lineitem)"


@query(_LINES + " select distinct up as src, 'CONSISTS_OF' as rel, part as dst from l where n > 1")
def i7_parts_list_edges(spark, d) -> DataFrame:
    """What assemblies consist of, from parts lists under any known headers."""
    return sh.parts_rows(lists(spark, d))[1]


@query(
    _LINES + """, p as (select part as name, '수량' as k, qty as v, 'BOM' || k as file, case when k % 2 = 0 then 'a' else 'b' end as sheet, row from l union all select part, '재질', mat, 'BOM' || k, 'a', row from l where k % 2 = 0)
    select name, k, count(*) as n from (select *, row_number() over (partition by name, k order by file, sheet, row) as place from p) where place = 1 group by name, k"""
)
def i7_parts_list_props(spark, d) -> DataFrame:
    """Which properties the parts of all lists get."""
    return sh.parts_rows(lists(spark, d))[0].groupBy("name", "k").agg(F.count("*").alias("n"))
