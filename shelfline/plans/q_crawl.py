"""Queries over crawl runs: discovery of many sites in one plan, what went wrong
with pages, known URLs, outcomes out of order, stored versions, large files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import read_table
from . import standins as S
from .page_crawl import crawl_pages
from .q_catalog import _STATE_SQL
from .registry import query


def _folder(spark, what: str) -> str:
    return os.path.join(checkpoint_dir(spark), what, uuid.uuid4().hex)


_SHOP = """
WITH p AS (
  SELECT p_partkey AS pk, p_partkey // 50 AS shop, (p_partkey // 50) % 4 AS k, (p_partkey // 50) % 5 AS pf,
    'https://shop' || CAST(p_partkey // 50 AS VARCHAR) || '.example.com' AS origin,
    ['/products/', '/product/', '/about/'][p_partkey % 3 + 1] || CAST(p_partkey AS VARCHAR) || '.html' AS path FROM part)"""


@query("discovery_plan", _SHOP + """,
l AS (
  SELECT *, [0, 0, pk] AS o FROM p WHERE k = 0 AND pk % 2 = 0
  UNION ALL SELECT *, [0, 1, pk] FROM p WHERE k = 0 AND pk % 2 = 1 AND pk % 7 = 0
  UNION ALL SELECT *, [1, -pk] FROM p WHERE k = 0
  UNION ALL SELECT *, [0, pk] FROM p WHERE k IN (1, 2)),
f AS (SELECT origin, path, k, min(o) AS o FROM l
      WHERE CASE pf WHEN 1 THEN contains(path, '/products/') WHEN 2 THEN contains(path, '.html') WHEN 3 THEN contains(path, '/products/')
                    WHEN 4 THEN contains(path, '/product/') ELSE contains(path, '/products/') OR contains(path, '/product/') END
        AND (k NOT IN (0, 1) OR starts_with(path, '/products/12') OR NOT (starts_with(path, '/products/1') OR starts_with(path, '/product/3')))
      GROUP BY origin, path, k),
r AS (SELECT origin, origin || path AS url, row_number() OVER (PARTITION BY origin ORDER BY o) AS place FROM f)
SELECT origin, url, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20
""")
def discovery_plan(spark, sf_dir):
    """D8 from robots files to D4 for many sites in one plan: S5, S4, S2, S3,
    D1 by platform, D2, D3, and the first 20 URLs of each site in walk order."""
    from ..operators.discovery import discover_sitemaps
    origins, robots, sitemaps = S.shop_discovery(spark, sf_dir)
    return discover_sitemaps(origins, robots, sitemaps, n=20)


@query("crawl_report", """
WITH p AS (SELECT *, p_partkey % 8 AS k, CAST(p_partkey AS VARCHAR) AS n, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part)
SELECT p_partkey AS page_id, k IN (1, 2) AS soft_404,
  CASE WHEN k IN (1, 2, 7) THEN 'skipped' WHEN k IN (3, 5) THEN 'failed' ELSE 'crawled' END AS status,
  CASE WHEN k IN (1, 2, 7) THEN 'No product data found' WHEN k = 3 THEN 'No product name found'
       WHEN k = 5 THEN 'Could not generate valid path from URL: https://store.example.com/' || repeat('a', 1000) || '/' || n END AS error,
  CASE WHEN k = 4 THEN 'Unknown availability value: "Perhaps"' WHEN k = 6 THEN 'No currency found, defaulting to USD' ELSE '' END AS warnings,
  CASE WHEN k IN (1, 2) THEN 'No data to transform' WHEN k IN (3, 7) THEN 'No product name found'
       WHEN k = 5 THEN 'Could not generate valid path from URL: https://store.example.com/' || repeat('a', 1000) || '/' || n ELSE '' END AS errors,
  CASE WHEN k = 0 THEN '1' || price END AS price_regular, CASE WHEN k IN (0, 4) THEN price END AS price_final
FROM p
""")
def crawl_report(spark, sf_dir):
    """Outcome of every page: S6 soft 404s, E15 sale prices, E20 rejects, and
    the warnings and errors of T3, T4."""
    out = crawl_pages(S.troubled_pages(spark, sf_dir))
    price = F.col("product.price")
    return out.select("page_id", "soft_404", "status", "error", F.array_join("warnings", "; ").alias("warnings"),
                      F.array_join("errors", "; ").alias("errors"), price["regular"].alias("price_regular"), price["final"].alias("price_final"))


@query("known_urls", """
WITH e AS (SELECT CASE WHEN user_id % 50 <> 7 THEN 'https://a.example.com/u/' || CAST(user_id AS VARCHAR) END AS url, event_id % 3 AS b FROM events)
SELECT url, CAST(min(b) AS BIGINT) AS batch_id FROM e GROUP BY url
""")
def known_urls(spark, sf_dir):
    """R1 over three batches: each URL (the null one too) enters with the first
    batch that has it; later batches ask the Bloom filters of their buckets and
    open those buckets only."""
    from ..streaming.known import KnownUrls
    events = read_table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("user_id") % 50 != 7, F.concat(F.lit("https://a.example.com/u/"), F.col("user_id").cast("string"))).alias("url"))
    known = KnownUrls(spark, _folder(spark, "known"), buckets=32)
    for b in range(3):
        found = events.filter(F.col("event_id") % 3 == b).select("url").distinct()
        known.add(known.unseen(found, b).checkpoint(), b)
    return spark.read.schema("url string, bucket int, batch_id long").parquet(f"{known.base}/urls").select("url", "batch_id")


@query("state_stream", _STATE_SQL + "SELECT url, status, error, crawled_at, ordinal FROM state")
def state_stream(spark, sf_dir):
    """R2 as a stream: the event log, shuffled over eight files and read two at
    a time, gives the rows of ``state_upsert``."""
    from ..streaming.outcomes import current_state, stream_outcomes
    log, base = _folder(spark, "log"), _folder(spark, "outcomes")
    S.crawl_events(spark, sf_dir).select(
        "url", F.unix_micros(F.col("seq.ts").cast("timestamp")).alias("seq1"), F.col("event_id").alias("seq2"), "status", "error",
        F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("event_id").alias("ordinal")) \
        .repartition(8, F.xxhash64("event_id")).write.parquet(log)
    stream_outcomes(spark, log, base, max_files=2)
    kind = read_table(spark, sf_dir, "events").schema["ts"].dataType
    return current_state(spark, base).withColumn("crawled_at", F.col("crawled_at").cast(kind))


@query("product_versions", """
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ' v2-5' ELSE p_name END AS name,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version
FROM part
""")
def product_versions(spark, sf_dir):
    """S11 over two crawls: the second has a third of the paths, each five
    times (the largest ordinal wins); the others keep their first record."""
    from ..schemas import PRODUCT
    from ..sources.products import read_versions, write_version
    prods = S.part_products(spark, sf_dir)
    full = prods.select("p_partkey", *[(F.col(f.name) if f.name in prods.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                       for f in PRODUCT.fields])
    path = _folder(spark, "versions")
    write_version(full, path, 1)
    again = full.filter("p_partkey % 3 = 0").withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.lit(5)))) \
        .withColumn("name", F.concat("name", F.lit(" v2-"), F.col("ordinal").cast("string")))
    write_version(again, path, 2, "ordinal")
    return read_versions(spark, path).select("sku", "name", "version")


@query("api_rejects", """
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_partkey % 4 = 0 THEN 'failed' ELSE 'found' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN 'Product not found' END AS error
FROM part
""")
def api_rejects(spark, sf_dir):
    """Listed products with their details, and those without as rejects."""
    from ..operators.api import join_details
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    sku = F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku")
    found, missing = join_details(part.select(sku), part.filter("p_partkey % 4 <> 0").select(sku, F.col("p_name").alias("name")))
    return found.select("sku", F.lit("found").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(missing)


@query("csv_split", """
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku, p_name || chr(10) || 'says "' || p_brand || '",' || chr(10) || chr(10) || 'twice' AS name,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price_final
FROM part
""")
def csv_split(spark, sf_dir):
    """S12 and S13 with quoted line breaks and quotes: one file, read in splits."""
    from ..operators import flat as FL
    from ..sources.quoted_csv import read_quoted_csv
    prods = S.part_products(spark, sf_dir).withColumn("name", F.concat("name", F.lit('\nsays "'), "brand", F.lit('",\n\ntwice')))
    none = spark.createDataFrame([], "parent_sku string, v struct<sku:string,name:string,url:string,images:array<struct<url:string,label:string,"
                                     "roles:array<string>>>,price:struct<currency:string,regular:string,final:string>,availability:string,"
                                     "options:array<struct<id:string,value:string,uid:string>>>")
    path = _folder(spark, "csv")
    FL.write_csv(FL.flat_rows(prods, none), path)
    rows = read_quoted_csv(spark, path)
    return rows.select("sku", "name", "price_final")


@query("sitemap_files", """
SELECT DISTINCT 'list-' || CAST(page_id % 4 AS VARCHAR) AS file, url AS loc, 'url' AS kind FROM pages
UNION ALL SELECT DISTINCT 'index', 'list-' || CAST(page_id % 4 AS VARCHAR), 'index' FROM pages
""")
def sitemap_files(spark, sf_dir):
    """S2 over XML files: four lists of all page URLs and their index, streamed
    element by element."""
    from ..sources.sitemaps import scan_sitemap_files
    pages = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 4).cast("string").alias("k"), "url")
    base = _folder(spark, "sitemaps")
    pages.select("k", F.col("url").alias("loc")).distinct().repartition("k").write.partitionBy("k") \
        .format("xml").option("rootTag", "urlset").option("rowTag", "url").save(f"{base}/list")
    pages.select(F.concat(F.lit("list-"), "k").alias("loc")).distinct().coalesce(1).write \
        .format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").save(f"{base}/index")
    found = scan_sitemap_files(spark, f"{base}/list").unionByName(scan_sitemap_files(spark, f"{base}/index"))
    name = F.when(F.col("file").contains("/index/"), F.lit("index")) \
        .otherwise(F.concat(F.lit("list-"), F.regexp_extract("file", "/k=(\\d+)/", 1)))
    return found.select(name.alias("file"), "loc", "kind")
