"""Robots.txt text -> rule rows, and per-origin rule sets for D2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(robots: DataFrame, origin_col: str = "origin", text_col: str = "text") -> DataFrame:
    """One row per directive: (origin, kind, ordinal, value).

    ``kind`` in sitemap | allow | disallow | crawl-delay.  Sitemap lines are
    global; allow/disallow/crawl-delay count only inside a ``User-agent: *``
    block.  The window runs per robots file (bounded by its line count).
    """
    lines = robots.select(origin_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    lines = lines.select(origin_col, "pos", F.trim(F.regexp_replace("raw", r"^[\s]+|[\s]+$", "")).alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    low = F.lower("line")

    def after(prefix):
        return F.trim(F.substring(F.col("line"), F.lit(len(prefix) + 1), F.length("line")))

    kind = (F.when(low.startswith("sitemap:"), F.lit("sitemap"))
            .when(low.startswith("user-agent:"), F.lit("agent"))
            .when(low.startswith("disallow:"), F.lit("disallow"))
            .when(low.startswith("allow:"), F.lit("allow"))
            .when(low.startswith("crawl-delay:"), F.lit("crawl-delay")))
    value = (F.when(kind == "sitemap", after("sitemap:")).when(kind == "agent", after("user-agent:"))
             .when(kind == "disallow", after("disallow:")).when(kind == "allow", after("allow:"))
             .when(kind == "crawl-delay", after("crawl-delay:")))
    typed = lines.select(origin_col, "pos", kind.alias("kind"), value.alias("value"))
    w = Window.partitionBy(origin_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    typed = typed.withColumn("agent", F.last(F.when(F.col("kind") == "agent", F.col("value")), True).over(w))
    wild = F.coalesce(F.col("agent") == "*", F.lit(False))
    keep = ((F.col("kind") == "sitemap")
            | (wild & F.col("kind").isin("allow", "disallow") & (F.col("value") != ""))
            | (wild & (F.col("kind") == "crawl-delay")
               & F.regexp_extract("value", r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1).isNotNull()
               & (F.regexp_extract("value", r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1) != "")))
    return typed.filter(keep).select(origin_col, "kind", F.col("pos").alias("ordinal"), "value")


def rule_sets(rules: DataFrame, origin_col: str = "origin") -> DataFrame:
    """Per origin: allow[], deny[] (file order), sitemaps[], crawl_delay."""
    def ordered(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind,
                                                              F.struct("ordinal", "value")))),
                           lambda s: s["value"])
    delay = F.max_by(F.when(F.col("kind") == "crawl-delay",
                            F.regexp_extract("value", r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1).cast("double")),
                     F.when(F.col("kind") == "crawl-delay", F.col("ordinal")))
    return rules.groupBy(origin_col).agg(ordered("allow").alias("allow"), ordered("disallow").alias("deny"),
                                         ordered("sitemap").alias("sitemaps"),
                                         F.coalesce(delay, F.lit(0.0)).alias("crawl_delay"))
