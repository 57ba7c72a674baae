"""Scalar, range, stats and category-tree facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_BUCKETS = 20


def scalar_facets(df: DataFrame, attrs: list[str], top: int = TOP_BUCKETS) -> DataFrame:
    """(facet, value, count, rank) with the ``top`` buckets per facet, from
    one scan for all attributes.

    Counting is a partial+final aggregation on (facet, value); the ranking
    window then runs per facet over distinct values only.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("facet"), F.col(a).cast("string").alias("value")) for a in attrs])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("facet").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def range_facet(df: DataFrame, col: str, width: float) -> DataFrame:
    """(from, to, count) over fixed-width buckets."""
    lo = (F.floor(F.col(col) / width) * width)
    return df.groupBy(lo.alias("from")).agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("to", F.col("from") + width).select("from", "to", "count")


def stats_facet(df: DataFrame, col: str) -> DataFrame:
    """min / max."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def category_tree(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """every path prefix as a node: name, level, parent, sorted children.

    Prefixes are exploded per path, de-duplicated, and children are gathered
    with one aggregation keyed by parent (a node's children are bounded by
    the category vocabulary, not by the product count).
    """
    segs = F.split(F.col(path_col), "/")
    pref = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)),
                                              lambda i: F.array_join(F.slice(segs, 1, i), "/"))).alias("node")) \
        .distinct()
    node_segs = F.split("node", "/")
    nodes = pref.select("node", F.element_at(node_segs, -1).alias("name"), F.size(node_segs).alias("level"),
                        F.when(F.size(node_segs) > 1,
                               F.array_join(F.slice(node_segs, 1, F.size(node_segs) - 1), "/")).alias("parent"))
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")) \
        .agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("children"))
    return nodes.join(kids, "node", "left").withColumn("children", F.coalesce("children", F.lit("")))
