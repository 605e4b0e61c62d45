"""A seed graph from short tables: weights written into relation names, documents numbered around objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import numbered


def weights_from_names(edges: DataFrame, rel: str = "SIMILAR") -> DataFrame:
    """Edges (src, rel, dst, ...) with ``weight``: "SIMILAR 0.87" becomes SIMILAR with the weight 0.87, other names stay."""
    value = F.regexp_extract("rel", rf"^{rel} ([0-9.]+)$", 1).try_cast("double")
    return edges.withColumn("weight", value).withColumn("rel", F.when(F.col("rel").startswith(f"{rel} "), rel).otherwise(F.col("rel")))


def satellites(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document nodes (id, type, label, sub, parent) and evidence edges (src, rel, dst) from rules (parent, n, kinds, ord).

    Each parent gets ``n`` documents, their kinds in turn; documents are numbered over all parents in order.
    """
    each = rules.where("n > 0").select("parent", "ord", "kinds", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.lit("D").alias("all"))
    rows = numbered(each, ["all"], ["ord", "parent", "i"], "k").withColumn("id", F.concat("all", (F.col("k") - 1).cast("string")))
    kind = F.element_at("kinds", F.col("i") % F.size("kinds") + 1)
    nodes = rows.select("id", F.lit("doc").alias("type"), F.concat(F.lit("document "), F.col("k").cast("string"), F.lit("."), kind).alias("label"), kind.alias("sub"), "parent")
    return nodes, rows.select(F.col("parent").alias("src"), F.lit("EVIDENCED_BY").alias("rel"), F.col("id").alias("dst"))
