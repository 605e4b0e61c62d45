"""A typed property graph out of the star-schema tables.

Nodes: ``canvas_id, id, type, label, sub, st, props, ord``; edges: ``canvas_id, src, rel, dst, weight, ord``.
``ord`` is the order of insertion, computed from keys, never by a global sort.  Columns that a query does not
use are pruned down to the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANVAS = "main"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), *(p if isinstance(p, Column) else F.col(p).cast("string") for p in parts))


def _props(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()))


def _nodes(df: DataFrame, kind: str, node_id: Column, label: Column, order: Column, sub: Column | None = None, props: Column | None = None) -> DataFrame:
    none = F.array().cast("array<struct<k:string,v:string>>")
    return df.select(
        F.lit(CANVAS).alias("canvas_id"),
        node_id.alias("id"),
        F.lit(kind).alias("type"),
        label.alias("label"),
        (sub if sub is not None else F.lit(None)).cast("string").alias("sub"),
        F.lit(None).cast("string").alias("st"),
        (props if props is not None else none).alias("props"),
        order.cast("long").alias("ord"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large returned lines: ``part, customer, fm, digit``."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_returnflag = 'R'")
    rows = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    digit = F.substring("o_orderpriority", 1, 1)
    return rows.select(F.col("l_partkey").alias("part"), F.col("o_custkey").alias("customer"), _id("F", F.col("l_returnflag"), F.col("l_linestatus"), digit).alias("fm"), digit.alias("digit"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    place = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    flags = t("lineitem").select("l_returnflag", "l_linestatus").distinct().withColumn("d", F.explode(F.array(*(F.lit(str(d)) for d in range(1, 6)))))
    flag_order = 500_000 + (F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")) * 10 + c("d").cast("int")
    flag_id = _id("F", c("l_returnflag"), c("l_linestatus"), c("d"))
    digit = F.substring("o_orderpriority", 1, 1)
    parts = [
        _nodes(t("region"), "reg", _id("R", "r_regionkey"), c("r_name"), c("r_regionkey")),
        _nodes(t("nation"), "item", _id("IN", "n_nationkey"), c("n_name"), 1000 + c("n_nationkey")),
        _nodes(flags, "fm", flag_id, flag_id, flag_order, props=_props(severity=10 - c("d").cast("int"))),
        _nodes(t("orders").select("o_orderpriority").distinct(), "cause", _id("C", digit), c("o_orderpriority"), 600_000 + digit.cast("int")),
        _nodes(t("customer").select("c_mktsegment").distinct(), "action", _id("A_", c("c_mktsegment")), c("c_mktsegment"), 700_000 + F.ascii("c_mktsegment")),
        _nodes(t("supplier"), "item", _id("IS", "s_suppkey"), c("s_name"), 10**9 + c("s_suppkey")),
        _nodes(
            t("part"), "item", _id("IP", "p_partkey"), c("p_name"), 10**12 + c("p_partkey"), c("p_type"),
            _props(material=c("p_brand"), size=c("p_size"), price=F.floor("p_retailprice")),
        ),
        _nodes(place, "proj", _id("PJ", "c_custkey"), c("c_name"), 2 * 10**12 + c("c_custkey"), props=_props(market=c("r_name"), segment=c("c_mktsegment"))),
        _nodes(t("documents"), "doc", _id("D", "doc_id"), F.concat("source", c("doc_id").cast("string")), 3 * 10**12 + c("doc_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edges(df: DataFrame, rel: str, src: Column, dst: Column, order: Column, weight: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(CANVAS).alias("canvas_id"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), (weight if weight is not None else F.lit(None)).cast("double").alias("weight"), order.cast("long").alias("ord")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    base = lambda n: F.lit(n * 10**16)
    step = 10**7
    bad = failures(spark, sf_dir)
    supplied = t("lineitem").where("l_linenumber = 1").select("l_suppkey", "l_partkey").distinct()
    place = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    struck = bad.select("customer", "fm", "digit").distinct()
    fm_order = F.ascii(F.substring("fm", 3, 1)) * 10 + c("digit").cast("int")
    fms = bad.select("fm", "digit").distinct()
    segments = bad.join(t("customer"), c("customer") == c("c_custkey")).groupBy("fm", "digit", "c_mktsegment").agg(F.count("*").alias("n"))
    most = Window.partitionBy("fm").orderBy(F.desc("n"), "c_mktsegment")
    main = segments.withColumn("place", F.row_number().over(most)).where("place = 1")
    under = struck.join(place, c("customer") == c("c_custkey")).select("fm", "digit", "n_regionkey").distinct()
    following = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    similar = t("customer").withColumns({"next": F.lead("c_custkey").over(following), "other": F.lead("c_acctbal").over(following)}).where("next is not null")
    docs = t("documents").agg(F.count("*").alias("docs"))
    proven = t("part").where("p_partkey % 10 <> 0").join(F.broadcast(docs), F.lit(True)).where("docs > 0").withColumn("doc", c("p_partkey") % c("docs"))
    part, customer = _id("IP", "part"), _id("PJ", "customer")
    cust = _id("PJ", "c_custkey")
    parts = [
        _edges(t("supplier"), "CONSISTS_OF", _id("IN", "s_nationkey"), _id("IS", "s_suppkey"), base(1) + c("s_suppkey")),
        _edges(supplied, "CONSISTS_OF", _id("IS", "l_suppkey"), _id("IP", "l_partkey"), base(2) + c("l_suppkey") * step + c("l_partkey")),
        _edges(bad.select("part", "fm", "digit").distinct(), "HAS_FAILURE", part, c("fm"), base(3) + c("part") * 10_000 + fm_order),
        _edges(struck, "OCCURRED_IN", customer, c("fm"), base(4) + c("customer") * 10_000 + fm_order),
        _edges(fms, "CAUSED_BY", c("fm"), _id("C", c("digit")), base(5) + fm_order),
        _edges(main, "MITIGATED_BY", c("fm"), _id("A_", c("c_mktsegment")), base(6) + fm_order),
        _edges(under, "UNDER_REG", c("fm"), _id("R", "n_regionkey"), base(7) + fm_order * 100 + c("n_regionkey")),
        _edges(place, "TARGET_MARKET", cust, _id("R", "n_regionkey"), base(8) + c("c_custkey")),
        _edges(similar, "SIMILAR", cust, _id("PJ", "next"), base(9) + c("c_custkey"), F.round(1 - F.least(F.abs(c("other") - c("c_acctbal")) / 10000, F.lit(1.0)), 2)),
        _edges(proven, "EVIDENCED_BY", _id("IP", "p_partkey"), _id("D", "doc"), base(10) + c("p_partkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


# The same graph in SQL, for the oracles: common table expressions ``nodes`` and ``edges``.
GRAPH_SQL = """
bad as (
  select l_partkey as part, o_custkey as customer, substr(o_orderpriority, 1, 1) as digit,
         'F' || l_returnflag || l_linestatus || substr(o_orderpriority, 1, 1) as fm
  from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 48 and l_returnflag = 'R'),
nodes as (
  select 'main' as canvas_id, 'R' || r_regionkey as id, 'reg' as type, r_name as label, cast(null as varchar) as sub,
         cast(null as varchar) as st, cast([] as struct(k varchar, v varchar)[]) as props, cast(r_regionkey as bigint) as ord from region
  union all select 'main', 'IN' || n_nationkey, 'item', n_name, null, null, [], 1000 + n_nationkey from nation
  union all select 'main', 'F' || rf || ls || d, 'fm', 'F' || rf || ls || d, null, null, [{'k': 'severity', 'v': cast(10 - d as varchar)}],
         500000 + (ascii(rf) * 100 + ascii(ls)) * 10 + d
    from (select distinct l_returnflag as rf, l_linestatus as ls from lineitem) f, (select unnest([1, 2, 3, 4, 5]) as d) g
  union all select 'main', 'C' || substr(p, 1, 1), 'cause', p, null, null, [], 600000 + cast(substr(p, 1, 1) as int)
    from (select distinct o_orderpriority as p from orders) o
  union all select 'main', 'A_' || s, 'action', s, null, null, [], 700000 + ascii(s) from (select distinct c_mktsegment as s from customer) c
  union all select 'main', 'IS' || s_suppkey, 'item', s_name, null, null, [], 1000000000 + s_suppkey from supplier
  union all select 'main', 'IP' || p_partkey, 'item', p_name, p_type, null,
         [{'k': 'material', 'v': p_brand}, {'k': 'size', 'v': cast(p_size as varchar)}, {'k': 'price', 'v': cast(cast(floor(p_retailprice) as bigint) as varchar)}],
         1000000000000 + p_partkey from part
  union all select 'main', 'PJ' || c_custkey, 'proj', c_name, null, null, [{'k': 'market', 'v': r_name}, {'k': 'segment', 'v': c_mktsegment}],
         2000000000000 + c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'main', 'D' || doc_id, 'doc', source || doc_id, null, null, [], 3000000000000 + doc_id from documents),
edges as (
  select 'main' as canvas_id, 'IN' || s_nationkey as src, 'CONSISTS_OF' as rel, 'IS' || s_suppkey as dst, cast(null as double) as weight,
         10000000000000000 + s_suppkey as ord from supplier
  union all select distinct 'main', 'IS' || l_suppkey, 'CONSISTS_OF', 'IP' || l_partkey, cast(null as double), 20000000000000000 + l_suppkey * 10000000 + l_partkey
    from lineitem where l_linenumber = 1
  union all select distinct 'main', 'IP' || part, 'HAS_FAILURE', fm, cast(null as double), 30000000000000000 + part * 10000 + ascii(substr(fm, 3, 1)) * 10 + cast(digit as int) from bad
  union all select distinct 'main', 'PJ' || customer, 'OCCURRED_IN', fm, cast(null as double), 40000000000000000 + customer * 10000 + ascii(substr(fm, 3, 1)) * 10 + cast(digit as int) from bad
  union all select distinct 'main', fm, 'CAUSED_BY', 'C' || digit, cast(null as double), 50000000000000000 + ascii(substr(fm, 3, 1)) * 10 + cast(digit as int) from bad
  union all select 'main', fm, 'MITIGATED_BY', 'A_' || c_mktsegment, cast(null as double), 60000000000000000 + ascii(substr(fm, 3, 1)) * 10 + cast(digit as int)
    from (select fm, digit, c_mktsegment, row_number() over (partition by fm order by count(*) desc, c_mktsegment) as place
          from bad join customer on customer = c_custkey group by fm, digit, c_mktsegment) m where place = 1
  union all select distinct 'main', fm, 'UNDER_REG', 'R' || n_regionkey, cast(null as double), 70000000000000000 + (ascii(substr(fm, 3, 1)) * 10 + cast(digit as int)) * 100 + n_regionkey
    from bad join customer on customer = c_custkey join nation on c_nationkey = n_nationkey
  union all select 'main', 'PJ' || c_custkey, 'TARGET_MARKET', 'R' || n_regionkey, cast(null as double), 80000000000000000 + c_custkey
    from customer join nation on c_nationkey = n_nationkey
  union all select 'main', 'PJ' || c_custkey, 'SIMILAR', 'PJ' || next, round(1 - least(abs(other - c_acctbal) / 10000, 1.0), 2), 90000000000000000 + c_custkey
    from (select c_custkey, c_acctbal, lead(c_custkey) over w as next, lead(c_acctbal) over w as other from customer
          window w as (partition by c_nationkey, c_mktsegment order by c_custkey)) s where next is not null
  union all select 'main', 'IP' || p_partkey, 'EVIDENCED_BY', 'D' || (p_partkey % docs), cast(null as double), 100000000000000000 + p_partkey
    from part, (select count(*) as docs from documents) d where p_partkey % 10 <> 0)
"""
