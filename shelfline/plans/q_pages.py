"""Queries over the ``pages`` table: flagship page catalog, path and SKU
derivation, HTML fields, platform detection (S6, E0-E3, E14, T1-T3, V1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import product_path, sku_from_url
from ..operators.extract import extract_pages
from ..operators.platforms import detect_platform
from ..sources.tables import read_table, stream_path
from .page_crawl import crawl_pages
from .registry import (query, sql_js_trim, sql_product_path, sql_sku_from_url, sql_tag_text)

_NAME = sql_js_trim(sql_tag_text("html", "h1"))
_TITLE = sql_js_trim(f"regexp_replace({sql_tag_text('html', 'title')}, '[\\t\\n\\f\\r ]+', ' ', 'g')")


@query("page_catalog", f"""
SELECT page_id, url, {sql_product_path('url')} AS path, {sql_sku_from_url('url')} AS sku,
       {_NAME} AS name, 'crawled' AS status
FROM pages
WHERE {sql_product_path('url')} IS NOT NULL AND {_NAME} <> ''
""")
def page_catalog(spark, sf_dir):
    """Flagship: pages -> soft-404 filter -> HTML/JSON-LD extraction ->
    transform -> validation; one row per page that yields a valid product."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = crawl_pages(pages)
    return out.filter(F.col("status") == "crawled").select(
        "page_id", "url", F.col("product.path").alias("path"), F.col("product.sku").alias("sku"),
        F.col("product.name").alias("name"), "status")


@query("product_path", f"""
SELECT page_id, url, {sql_product_path('url')} AS path FROM pages
""")
def product_path_q(spark, sf_dir):
    """T1 on every page URL (NULL when no valid path results)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", "url", product_path("url").alias("path"))


@query("sku_from_url", f"""
SELECT page_id, url, {sql_sku_from_url('url')} AS sku FROM pages
""")
def sku_from_url_q(spark, sf_dir):
    """T2 fallback SKU derivation on every page URL."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", "url", sku_from_url("url").alias("sku"))


@query("page_fields", f"""
SELECT page_id, url, {_NAME} AS name, {_TITLE} AS meta_title, false AS soft_404
FROM pages
""")
def page_fields(spark, sf_dir):
    """E0 tokenizer + E1 selectors + E14: product name (title selectors) and
    meta title for every page, with the S6 soft-404 flag."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ex = extract_pages(pages)
    return ex.select("page_id", "url", F.col("raw.name").alias("name"),
                     F.col("raw.metaTitle").alias("meta_title"), "soft_404")


@query("platform_detect", """
SELECT page_id, url,
  CASE WHEN regexp_matches(html, 'window\\.Shopify\\b|\\bShopify\\s*=|\\bShopify\\.(shop|theme|routes)')
         OR contains(html, 'cdn.shopify.com') THEN 'shopify'
       WHEN regexp_matches(html, 'window\\.Mage\\b|\\bMage\\s*=|require\\.s\\.contexts\\._')
         OR (contains(html, '/static/version') AND regexp_matches(html, '(?i)<input\\b[^>]*\\bname\\s*=\\s*["'']?form_key\\b')) THEN 'magento'
       WHEN regexp_matches(html, '\\bBCData\\b') OR regexp_matches(html, '(?i)<[a-z][^>]*\\sdata-stencil\\b') THEN 'bigcommerce'
       WHEN regexp_matches(html, '\\bwc_add_to_cart_params\\b|\\bwc_cart_params\\b')
         OR (regexp_matches(html, '(?i)<body\\b[^>]*\\bclass\\s*=\\s*["''][^"'']*\\bwoocommerce\\b')
             AND (contains(html, 'wc-add-to-cart') OR contains(html, 'woocommerce'))) THEN 'woocommerce'
       ELSE 'generic' END AS platform
FROM pages
""")
def platform_detect(spark, sf_dir):
    """E2 platform detection on every page (source probes, priority order)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", detect_platform("html")["platform"].alias("platform"))


@query("ingest_crawl", f"""
SELECT page_id, url, {sql_product_path('url')} AS path, {_NAME} AS name
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS nth FROM pages)
WHERE nth = 1 AND {sql_product_path('url')} IS NOT NULL AND {_NAME} <> ''
""")
def ingest_crawl(spark, sf_dir):
    """The page files streamed through E, T, V, R1 and R2 in two runs, the
    second resuming after the first; the valid products of all batches."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..streaming import ingest
    schema = read_table(spark, sf_dir, "pages").select("page_id", "url", "html").schema
    base = os.path.join(checkpoint_dir(spark), "crawl", uuid.uuid4().hex)
    for _ in range(2):
        ingest.ingest_crawl(spark, stream_path(sf_dir, "pages"), schema, base)
    out = spark.read.parquet(os.path.join(base, "pages")).filter("status = 'crawled'")
    return out.select("page_id", "url", F.col("product.path").alias("path"), F.col("product.name").alias("name"))
