"""Queries exercising page extraction end to end (E0-E23 -> T -> V) and
link discovery (D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.discovery import product_links
from ..sources.tables import read_table
from . import standins as S
from .page_crawl import crawl_pages, crawl_shops
from .registry import query, sql_product_path

_URL = "'https://store.example.com/' || split_part(p_name, ' ', 2) || '/' || CAST(p_partkey AS VARCHAR) || '.html'"


@query("jsonld_products", f"""
SELECT p_partkey AS page_id, {sql_product_path(_URL)} AS path, 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
  p_name AS name, p_brand AS brand, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS gtin,
  regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS price_final, 'USD' AS currency,
  CASE WHEN p_size % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END AS availability,
  'https://store.example.com/img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image,
  CAST(p_size % 5 + 1 AS VARCHAR) AS rating, CAST(p_size AS VARCHAR) AS review_count
FROM part
""")
def jsonld_products(spark, sf_dir):
    """E0 + E4-E11 + E19 + T1-T12 + V1 on JSON-LD product pages rendered from part."""
    pages = S.jsonld_pages(spark, sf_dir)
    out = crawl_pages(pages).filter(F.col("status") == "crawled")
    p = F.col("product")
    return out.select("page_id", p["path"].alias("path"), p["sku"].alias("sku"), p["name"].alias("name"),
                      p["brand"].alias("brand"), p["gtin"].alias("gtin"), p["price"]["final"].alias("price_final"),
                      p["price"]["currency"].alias("currency"), p["availability"].alias("availability"),
                      F.get(p["images"], 0)["url"].alias("image"),
                      p["aggregateRating"]["ratingValue"].alias("rating"),
                      p["aggregateRating"]["reviewCount"].alias("review_count"))


NAV_LINKS = ["nav a"]


def _sql_encode_path(x: str) -> str:
    return ("array_to_string(list_transform(string_split(" + x + ", ''), lambda c: CASE "
            "WHEN regexp_full_match(c, '[!$-;=@-_a-z|~]') THEN c ELSE url_encode(c) END), '')")


@query("page_links", """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav\\b.*?</nav>', 0),
             '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1) || """
    + _sql_encode_path("split_part(split_part(href, '?', 1), '#', 1)") + """ AS link FROM a WHERE starts_with(href, '/'))
SELECT DISTINCT page_id, link FROM r
""")
def page_links(spark, sf_dir):
    """Links of every page's navigation block through E0/E1, absolutised,
    http(s) only, query and fragment cut, de-duplicated per page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return product_links(pages, NAV_LINKS, ["page_id"])


@query("sitemap_urls", """
SELECT DISTINCT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1) AS origin, url FROM pages
""")
def sitemap_urls(spark, sf_dir):
    """S4 fallback location choice, S2 XML parsing, S3 index resolution over
    sitemap documents rendered per site from pages."""
    from ..sources.sitemaps import fallback_roots, parse_sitemaps, resolve
    docs = S.sitemap_docs(spark, sf_dir)
    parsed = parse_sitemaps(docs.select("url", "xml"))
    origins = docs.select("origin").distinct()
    roots = fallback_roots(origins, parsed)
    return resolve(roots.withColumn("place", F.lit(0)), parsed).select("origin", "url")


@query("pagination", """
WITH RECURSIVE p AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1) AS origin FROM pages),
e AS (SELECT url, coalesce(lead(url) OVER (PARTITION BY origin ORDER BY page_id),
                           CASE WHEN page_id % 2 = 0 THEN url END) AS nxt FROM p),
s AS (SELECT origin, arg_min(url, page_id) AS url FROM p GROUP BY origin),
t(origin, url, step) AS (SELECT origin, url, 1 FROM s
  UNION ALL SELECT t.origin, e.nxt, t.step + 1 FROM t JOIN e ON e.url = t.url
  WHERE e.nxt IS NOT NULL AND e.nxt <> t.url AND e.nxt IN (SELECT url FROM pages))
SELECT origin, url, CAST(step AS INTEGER) AS step FROM t
""")
def pagination(spark, sf_dir):
    """D6 next-page edges (E0 + platform next-page selectors) and D7 traversal from each site's first listing page."""
    from ..operators.discovery import next_page_edges, traverse
    from ..operators.platforms import CATEGORY_SELECTORS
    pages = S.listing_pages(spark, sf_dir)
    edges = next_page_edges(pages, CATEGORY_SELECTORS["generic"]["nextPage"])
    starts = pages.groupBy("origin").agg(F.min_by("url", "page_id").alias("url"))
    out = traverse(starts, edges, pages.select("url"))
    return out.select("origin", "url", F.col("step").cast("int").alias("step"))


@query("embedded_variants", """
WITH pr AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS ln,
                   arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS rf FROM lineitem GROUP BY l_partkey, l_suppkey),
c AS (SELECT pr.*, p_name, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn
      FROM pr JOIN part ON pr.l_partkey = part.p_partkey)
SELECT CAST(l_partkey AS VARCHAR) AS sku, 'P-' || CAST(l_partkey AS VARCHAR) || '-S-' || CAST(l_suppkey AS VARCHAR) AS variant_sku,
  p_name || ' / ' || CAST(ln AS VARCHAR) AS name,
  CAST(CAST(cents AS DECIMAL(38,2)) / 100 AS DECIMAL(38,2))::VARCHAR AS price_final,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(CAST(cents + 1000 AS DECIMAL(38,2)) / 100 AS DECIMAL(38,2))::VARCHAR END AS price_regular,
  CASE WHEN rf = 'N' THEN 'InStock' ELSE 'OutOfStock' END AS availability,
  'size=' || CAST(ln AS VARCHAR) || '|color=' || split_part(p_name, ' ', 1) AS options,
  'https://cdn.example.com/' || CAST(l_partkey AS VARCHAR) || '.jpg' AS image
FROM c
  -- image_id = part key; 0 is falsy, so no image and the variant is dropped
  WHERE l_partkey <> 0
""")
def embedded_variants(spark, sf_dir):
    """E21-E23 (Shopify platform): embedded variant JSON wins over JSON-LD,
    cents -> 2 decimals, image by id, option names; then T10 and V1."""
    pages = S.shopify_pages(spark, sf_dir)
    out = crawl_pages(pages, platform="shopify").filter(F.col("status") == "crawled")
    v = out.select(F.col("product.sku").alias("sku"), F.explode("product.variants").alias("v"))
    return v.select("sku", F.col("v.sku").alias("variant_sku"), F.col("v.name").alias("name"),
                    F.col("v.price.final").alias("price_final"), F.col("v.price.regular").alias("price_regular"),
                    F.col("v.availability").alias("availability"),
                    F.array_join(F.transform("v.options", lambda o: F.concat(o["id"], F.lit("="), o["value"])), "|")
                    .alias("options"),
                    F.get(F.col("v.images"), 0)["url"].alias("image"))


@query("merge_sources", """
SELECT p_partkey AS page_id,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (html)' END AS name,
  'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_brand AS brand, '<p>Desc ' || p_brand || '</p>' AS description,
  CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')
       ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_final,
  'EUR' AS currency, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_images,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-a.jpg'
       ELSE 'https://store.example.com/img/' || CAST(p_partkey AS VARCHAR) || '-b.jpg' END AS first_image
FROM part
""")
def merge_sources(spark, sf_dir):
    """E14-E18 HTML fields merged with JSON-LD (E19: JSON-LD wins, prices
    merge field by field, images JSON-LD first then HTML), then T and V1."""
    pages = S.mixed_pages(spark, sf_dir)
    out = crawl_pages(pages).filter(F.col("status") == "crawled")
    p = F.col("product")
    return out.select("page_id", p["name"].alias("name"), p["sku"].alias("sku"), p["brand"].alias("brand"),
                      p["description"].alias("description"), p["price"]["final"].alias("price_final"),
                      p["price"]["currency"].alias("currency"), F.size(p["images"]).alias("n_images"),
                      F.get(p["images"], 0)["url"].alias("first_image"))


@query("url_list", "SELECT DISTINCT url FROM pages")
def url_list(spark, sf_dir):
    """S1 scan of URL list files (comments, blank and padded lines mixed in)
    written from the page URLs, then D3 de-duplication."""
    import os
    import uuid

    from ..operators.discovery import dedupe_first
    from ..session import checkpoint_dir
    from ..sources.urllist import scan_url_list
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    lines = pages.select(F.explode(F.array(
        F.concat(F.lit("# page "), F.col("page_id").cast("string")),
        F.concat(F.lit("  "), F.col("url"), F.lit(" ")),
        F.lit(""), F.col("url"))).alias("value"))
    path = os.path.join(checkpoint_dir(spark), "urllists", uuid.uuid4().hex)
    lines.write.mode("overwrite").text(path)
    found = scan_url_list(spark, path).select("url", F.struct("file", "line").alias("ordinal"))
    return dedupe_first(found).select("url")


@query("discovery_union", """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav\\b.*?</nav>', 0),
             '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1) || array_to_string(list_transform(string_split(split_part(split_part(href, '?', 1), '#', 1), ''), lambda c: CASE WHEN regexp_full_match(c, '[!$-;=@-_a-z|~]') THEN c ELSE url_encode(c) END), '') AS link FROM a WHERE starts_with(href, '/')),
f AS (SELECT url, 1 AS p FROM pages UNION ALL SELECT link, 2 FROM r UNION ALL SELECT url, 3 FROM pages)
SELECT url, CASE min(p) WHEN 1 THEN 'sitemap' WHEN 2 THEN 'category' ELSE 'urls' END AS mode FROM f GROUP BY url
""")
def discovery_union(spark, sf_dir):
    """Sitemap, category and URL-list frontiers in one frame with their
    mode; D3 keeps each URL once with the first mode in priority order."""
    from ..operators.discovery import dedupe_first, discovery_union as union
    frontier = union(sitemap=sitemap_urls(spark, sf_dir).select("url"),
                     category=page_links(spark, sf_dir).select(F.col("link").alias("url")),
                     urls=url_list(spark, sf_dir).select("url"))
    prio = F.when(F.col("mode") == "sitemap", 1).when(F.col("mode") == "category", 2).otherwise(3)
    first = dedupe_first(frontier.select("url", F.struct(prio.alias("p"), F.col("mode")).alias("ordinal")))
    return first.select("url", F.col("ordinal.mode").alias("mode"))


@query("shop_catalog", """
SELECT CAST(p_partkey AS BIGINT) AS page_id, ['shopify', 'magento', 'bigcommerce', 'woocommerce', 'generic'][p_partkey % 5 + 1] AS platform,
  p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price_final
FROM part
""")
def shop_catalog(spark, sf_dir):
    """E2 on each site's homepage, E3 routing, then E0-E20, T and V1 with each
    site's own selectors, over shops of all five platforms."""
    out = crawl_shops(S.shop_pages(spark, sf_dir)).filter((F.col("status") == "crawled") & F.col("page_id").isNotNull())
    return out.select("page_id", "platform", F.col("product.name").alias("name"), F.col("product.price.final").alias("price_final"))


@query("category_links", """
WITH l AS (SELECT DISTINCT p_partkey // 10 AS n FROM part),
r AS (SELECT n, n - n % 10 AS start FROM l),
ok AS (SELECT n, start, count(*) OVER (PARTITION BY start ORDER BY n) - 1 = n - start AS reached FROM r)
SELECT CAST(p_partkey // 100 AS BIGINT) AS category, 'https://store.example.com/products/' || CAST(p_partkey AS VARCHAR) AS link
FROM part JOIN ok ON p_partkey // 10 = ok.n WHERE ok.reached
""")
def category_links(spark, sf_dir):
    """D5 + D6 + D7: product links of all pages reached from each category's
    first listing, once for each category."""
    from ..operators.discovery import next_page_edges, traverse
    from ..operators.platforms import CATEGORY_SELECTORS
    pages = S.category_pages(spark, sf_dir)
    cfg = CATEGORY_SELECTORS["generic"]
    starts = pages.filter("n % 10 = 0").select(F.col("category").cast("long").alias("origin"), "url")
    reached = traverse(starts, next_page_edges(pages, cfg["nextPage"]), pages.select("url"))
    links = product_links(pages, cfg["productLinks"], ["url"])
    return reached.join(links, "url").select(F.col("origin").alias("category"), "link").distinct()
