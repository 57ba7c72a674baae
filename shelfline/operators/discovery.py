"""Product-URL predicate, robots filter, dedupe, cap, links, listings and
discovery of many sites in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_
from ..functions.urls import url_pathname

# --- fixed values: product URL patterns ---------------------------------------
DEFAULT_PRODUCT_PATTERNS = ['/product/', '/products/', '/shop/', '/p/', '/dp/', '/catalog/product/',
                            '/item/', '/goods/']
PLATFORM_PATTERNS = {
    "shopify": ['/products/'],
    "magento": ['/catalog/product/', '.html'],
    "bigcommerce": ['/products/'],
    "woocommerce": ['/product/'],
}
# ------------------------------------------------------------------------------


def product_url_patterns(platform: str | None = None, custom: list[str] | None = None) -> list[str]:
    """A known platform replaces the defaults; custom patterns come first."""
    return list(custom or []) + PLATFORM_PATTERNS.get(platform or "", DEFAULT_PRODUCT_PATTERNS)


def is_product_url(url, platform: str | Column | None = None, custom: list[str] | None = None) -> Column:
    """Lower-cased URL contains any pattern.  ``platform`` may be a column:
    every row is then tested with its own platform's patterns."""
    low = F.lower(col_(url))

    def any_of(name):
        out = F.lit(False)
        for p in product_url_patterns(name, custom):
            out = out | low.contains(p)
        return out
    if not isinstance(platform, Column):
        return any_of(platform)
    case = F.when(F.lit(False), F.lit(False))
    for name in PLATFORM_PATTERNS:
        case = case.when(platform == name, any_of(name))
    return case.otherwise(any_of(None))


def apply_robots(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """D2 over a URL frame: adds ``allowed``; ``rules`` are the rule rows of
    ``robots_rules``.  Any allow prefix wins, then any deny prefix blocks, else
    a URL is allowed.

    Rules are looked up, not tried in turn: of each distinct path the prefixes
    at the lengths its origin has rules of are joined by equality to the rules,
    so ten thousand rules of an origin cost a path no more lookups than they
    have different lengths.
    """
    from ..functions.urls import url_origin
    kind = F.col("kind")
    rule = rules.filter(kind.isin("allow", "disallow")).groupBy(F.col("origin").alias("_origin"), F.col("value").alias("_prefix")) \
        .agg(F.max(kind == "allow").alias("_allow"), F.max(kind == "disallow").alias("_deny"))
    lengths = rule.groupBy("_origin").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    placed = urls.withColumn("_origin", url_origin(F.col(url_col))) \
        .withColumn("_path", F.coalesce(url_pathname(F.col(url_col)), F.col(url_col)))
    paths = placed.select("_origin", "_path").distinct().join(lengths, "_origin")
    probes = paths.select("_origin", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n")) \
        .select("_origin", "_path", F.substring(F.col("_path"), F.lit(1), F.col("_n")).alias("_prefix"))
    verdict = probes.join(rule, ["_origin", "_prefix"]).groupBy("_origin", "_path") \
        .agg(F.max("_allow").alias("_allow"), F.max("_deny").alias("_deny"))
    return placed.join(verdict, ["_origin", "_path"], "left") \
        .select(*urls.columns, F.coalesce(F.col("_allow") | ~F.col("_deny"), F.lit(True)).alias("allowed"))


def dedupe_first(urls: DataFrame, url_col: str = "url", ordinal_col: str = "ordinal") -> DataFrame:
    """D3: one row per URL with its first-encounter ordinal (partial aggregation
    before the shuffle, so hot URLs cost one row per map task)."""
    return urls.groupBy(url_col).agg(F.min(ordinal_col).alias(ordinal_col))


def cap(urls: DataFrame, n: int | None, ordinal_col: str = "ordinal") -> DataFrame:
    """First ``n`` by discovery order (TakeOrderedAndProject); None = all."""
    return urls if not n else urls.orderBy(ordinal_col).limit(n)


def discovery_union(**frontiers: DataFrame) -> DataFrame:
    """Union of the per-mode frontiers with a ``mode`` column."""
    out = None
    for mode, df in frontiers.items():
        d = df.withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out


def cap_each(urls: DataFrame, n: int | None, group: str = "origin", ordinal_col: str = "ordinal") -> DataFrame:
    """D4 for each ``group``: adds ``place`` (from 1) and keeps the first ``n``.
    With ``n`` every task keeps n rows of a group before the shuffle."""
    ranked = urls.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(ordinal_col)))
    return ranked.filter(F.col("place") <= n) if n else ranked


def discover_sitemaps(origins: DataFrame, robots: DataFrame, sitemaps: DataFrame, n: int | None = None) -> DataFrame:
    """D8, sitemap mode, for many sites in one plan: ``(origin, url, place)``.

    ``origins(origin, platform)``, ``robots(origin, text)``, ``sitemaps(url, xml)``.
    An origin starts from the sitemaps its robots file lists, or else from the
    first common location that leads to any URL (S4); indexes are resolved
    (S3), then D1 by the origin's platform, D2 by its robots rules, D3, and D4
    with ``n``.  The order is that of a depth-first walk: the place of the
    sitemap in the robots file, of the child in its index, of the URL in its
    list.
    """
    from ..session import checkpoint_dir
    from ..sources.robots import robots_rules
    from ..sources.sitemaps import candidates, parse_sitemaps, resolve
    rules = robots_rules(robots)
    listed = rules.filter(F.col("kind") == "sitemap").select("origin", F.col("value").alias("url"), F.col("ordinal").alias("place"))
    told = listed.select("origin").distinct()
    roots = origins.select("origin").join(listed, "origin") \
        .unionByName(candidates(origins.select("origin").join(told, "origin", "left_anti")))
    checkpoint_dir(origins.sparkSession)
    found = resolve(roots, parse_sitemaps(sitemaps).checkpoint())  # each document is parsed once, not once a level
    # without sitemaps in robots only the first location that yields URLs counts
    first = found.join(told, "origin", "left_anti").groupBy("origin").agg(F.min(F.get("ordinal", 0)).alias("_first"))
    found = found.join(first, "origin", "left").filter(F.col("_first").isNull() | (F.get("ordinal", 0) == F.col("_first"))).drop("_first")
    product = found.join(origins, "origin").filter(is_product_url("url", F.col("platform"))).select("origin", "url", "ordinal")
    return cap_each(apply_robots(product, rules).filter("allowed"), n).select("origin", "url", "place")


def next_page_edges(pages, selectors: list[str], url_col: str = "url", html_col: str = "html"):
    """(url, next) -- the first next-page selector that matches anything
    gives the element; its href, absolutised, is the edge (NULL if none)."""
    from ..functions.urls import resolve_url
    from .fields import hrefs
    found = hrefs(pages.select(F.col(url_col).alias("url"), html_col), selectors, "_next", html_col)
    href = F.get("_next", 0)
    return found.select("url", resolve_url(F.when(href != "", href), F.col("url")).alias("next"))


def product_links(pages, selectors: list[str], keys: list[str], url_col: str = "url", html_col: str = "html"):
    """(keys..., link), each page's product links once: every selector's
    matches, absolutised, http(s) only, query and fragment cut."""
    from .fields import hrefs
    found = hrefs(pages.select(*keys, F.col(url_col).alias("_page"), html_col), selectors, "_hrefs", html_col)
    return links_of(found, keys)


def links_of(found, keys: list[str], hrefs_col: str = "_hrefs", page_col: str = "_page"):
    """D5 on hrefs read before."""
    from ..functions.urls import resolve_url
    each = found.select(*keys, page_col, F.explode(F.array_distinct(hrefs_col)).alias("_href")).filter("_href <> ''")
    full = each.select(*keys, resolve_url("_href", F.col(page_col)).alias("_full")).filter(F.col("_full").startswith("http"))
    return full.select(*keys, F.split_part(F.split_part("_full", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("link")).distinct()


def traverse(starts, edges, known):
    """All pages reached from each start over next edges, with their step
    (1: the start); stops at a missing page, a NULL next, next == current and
    at a page already seen.

    Every page has one next page, so reach doubles: with the edges that jump
    ``n`` pages, the first ``n`` pages of a list give its first ``2n``.  Lists
    of any length take log2(length) rounds; each round is checkpointed to the
    shared folder.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(starts.sparkSession)
    known_urls = known.select(F.col("url").alias("next")).distinct()
    jump = edges.filter(F.col("next").isNotNull() & (F.col("next") != F.col("url"))) \
        .groupBy("url").agg(F.min("next").alias("next")).join(known_urls, "next").select("url", "next").checkpoint()
    seen = starts.select("origin", "url", F.lit(1).alias("step")).checkpoint()
    size, length = seen.count(), 1
    while True:
        further = seen.join(jump, "url").select("origin", F.col("next").alias("url"), (F.col("step") + length).alias("step"))
        seen = seen.unionByName(further).groupBy("origin", "url").agg(F.min("step").alias("step")).checkpoint()
        grown = seen.count()
        if grown == size:
            return seen
        size, length = grown, length * 2
        then = jump.select(F.col("url").alias("next"), F.col("next").alias("_then"))
        jump = jump.join(then, "next").select("url", F.col("_then").alias("next")).checkpoint()
