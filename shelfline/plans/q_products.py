"""Queries for validation (V1), top-level options (T11) and incremental
ingest (R10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.enums import AVAILABILITY_VALUES
from ..functions.text import once
from ..functions.urls import product_path, sku_from_url
from ..operators.transform import top_level_options
from ..operators.validate import validate_product
from ..schemas import PRODUCT
from ..sources.tables import read_table, stream_path
from ..streaming.ingest import ingest_pages
from . import standins as S
from .registry import query, sql_product_path, sql_sku_from_url

_AV = ", ".join(AVAILABILITY_VALUES)


def validation_errors_products(spark, sf_dir):
    """Part products (PRODUCT schema) with faults injected into some records."""
    p = S.part_products(spark, sf_dir)
    k = F.pmod(F.col("p_partkey"), F.lit(6))
    img_t = "array<struct<url:string,label:string,roles:array<string>>>"
    bad_variant = F.array(F.struct(F.lit("").alias("sku"), F.lit("x").alias("name"), F.lit("").alias("url"),
                                   F.lit(None).cast(img_t).alias("images"),
                                   F.lit(None).cast("struct<currency:string,regular:string,final:string>").alias("price"),
                                   F.lit(None).cast("string").alias("availability"),
                                   F.lit(None).cast("array<struct<id:string,value:string,uid:string>>").alias("options")))
    prod = F.struct(
        F.when(k == 3, F.lit("Bad Path")).otherwise(F.col("path")).alias("path"), F.col("sku"),
        F.when(k == 1, F.lit("")).otherwise(F.col("name")).alias("name"), F.col("url"), F.col("description"),
        F.col("metaTitle"), F.col("metaDescription"), F.col("brand"), F.lit(None).cast("string").alias("gtin"),
        F.col("price"), F.when(k == 2, F.lit("Sometimes")).otherwise(F.col("availability")).alias("availability"),
        F.lit(None).cast("string").alias("itemCondition"),
        F.when(k == 4, F.array(F.struct(F.lit("").alias("url"), F.lit(None).cast("string").alias("label"),
                                        F.lit(None).cast("array<string>").alias("roles"))))
        .otherwise(F.col("images")).alias("images"),
        F.lit(None).cast("struct<ratingValue:string,reviewCount:string,bestRating:string,worstRating:string>")
        .alias("aggregateRating"),
        F.when(k == 5, bad_variant).alias("variants"),
        F.lit(None).cast(PRODUCT["options"].dataType).alias("options"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(None).cast(PRODUCT["custom"].dataType).alias("custom")).cast(PRODUCT)
    return p.select(prod.alias("_p")).select("_p.*")


@query("validation_errors", f"""
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
  CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 5 THEN 3 ELSE 1 END AS n_errors,
  CASE p_partkey % 6 WHEN 0 THEN ''
    WHEN 1 THEN 'name is required and must be a string'
    WHEN 2 THEN 'availability must be one of: {_AV}'
    WHEN 3 THEN 'path "Bad Path" does not match required pattern'
    WHEN 4 THEN 'images[0].url is required and must be a string'
    ELSE 'variants[0].sku is required; variants[0].url is required; variants[0].images is required and must be an array'
  END AS errors
FROM part
""")
def validation_errors(spark, sf_dir):
    """V1 on every part product, with faults injected into some records."""
    p = validation_errors_products(spark, sf_dir)
    errs = validate_product(F.struct(*[F.col(c) for c in p.columns]))
    return p.select("sku", F.size(errs).alias("n_errors"), F.array_join(errs, "; ").alias("errors"))


@query("product_options", """
WITH pr AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS ln
            FROM lineitem GROUP BY l_partkey, l_suppkey),
o AS (SELECT 'P-' || CAST(l_partkey AS VARCHAR) AS sku, l_suppkey, 'size' AS option_id, 1 AS position,
             CAST(ln AS VARCHAR) AS value, 'S' || CAST(l_suppkey AS VARCHAR) AS uid FROM pr
      UNION ALL
      SELECT 'P-' || CAST(l_partkey AS VARCHAR), l_suppkey, 'color', 2, split_part(p_name, ' ', 1),
             'C' || CAST(l_suppkey AS VARCHAR) FROM pr JOIN part ON pr.l_partkey = part.p_partkey),
v AS (SELECT sku, option_id, position, value, min(l_suppkey) AS first, arg_min(uid, l_suppkey) AS uid
      FROM o GROUP BY sku, option_id, position, value)
SELECT sku, option_id, CASE option_id WHEN 'size' THEN 'Size' ELSE 'Color' END AS label,
       CAST(position AS INTEGER) AS position,
       CAST(row_number() OVER (PARTITION BY sku, option_id ORDER BY first) AS INTEGER) AS value_position,
       value, uid
FROM v
""")
def product_options(spark, sf_dir):
    """Top-level options of every product from its variants (supplier order)."""
    v = S.lineitem_variants(spark, sf_dir)
    per = v.groupBy("parent_sku").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_suppkey", "v"))), lambda x: x["v"]).alias("vs"))
    opts = per.select(F.col("parent_sku").alias("sku"), once(top_level_options(F.col("vs"))).alias("os"))
    vals = opts.select("sku", F.explode("os").alias("o")).select("sku", "o.id", "o.label", "o.position", F.posexplode("o.values").alias("vp", "val"))
    return vals.select("sku", F.col("id").alias("option_id"), "label", F.col("position").cast("int"),
                       (F.col("vp") + 1).cast("int").alias("value_position"), F.col("val.value").alias("value"),
                       F.col("val.uid").alias("uid"))


@query("ingest_stream", f"""
SELECT page_id, url, {sql_product_path('url')} AS path, {sql_sku_from_url('url')} AS sku FROM pages
""")
def ingest_stream(spark, sf_dir):
    """Structured Streaming (availableNow) over the page files; each
    micro-batch derives path and SKU (T1, T2); URLs de-duplicated in state."""
    schema = read_table(spark, sf_dir, "pages").select("page_id", "url", "html").schema
    sink = ingest_pages(spark, stream_path(sf_dir, "pages"), schema,
                        lambda b: b.select("page_id", "url", product_path("url").alias("path"),
                                           sku_from_url("url").alias("sku")),
                        columns=["page_id", "url"])
    return spark.read.parquet(sink).select("page_id", "url", "path", "sku")


API_BASE = "https://www.store.com"


@query("api_simple", """
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
  '/products/' || split_part(p_name, ' ', 2) || '-' || CAST(p_partkey AS VARCHAR) || '/p-' || CAST(p_partkey AS VARCHAR) AS path,
  p_name AS name, p_name || ' by ' || p_brand AS description, p_brand AS brand,
  regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS price_final,
  regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 10 AS VARCHAR), '0+$', ''), '\\.$', '') AS price_regular,
  'USD' AS currency,
  CASE p_size % 3 WHEN 1 THEN 'InStock' WHEN 2 THEN 'OutOfStock' END AS availability,
  'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image
FROM part
""")
def api_simple(spark, sf_dir):
    """N1-N6, N10 on simple product views, then T1-T12 and V1."""
    from ..operators.api import normalize_product, source_url
    from ..operators.transform import transform_product
    views = S.api_simple_views(spark, sf_dir)
    from pyspark.sql.types import ArrayType

    from ..schemas import API_VARIANT
    no_variants = F.array().cast(ArrayType(API_VARIANT))
    raw = views.select(once(normalize_product(F.col("pv"), no_variants, API_BASE)).alias("raw"),
                       source_url(F.col("pv"), API_BASE).alias("_src"))
    raw = raw.select("raw", F.coalesce(F.col("raw.url"), F.col("_src")).alias("src"))
    # the normaliser and the transform are planned one by one (see page_crawl)
    t = raw.select(once(transform_product(F.col("raw"), F.col("src"))).alias("t")).select("t.product")
    p = F.col("product")
    return t.filter(p.isNotNull()).select(
        p["sku"].alias("sku"), p["path"].alias("path"), p["name"].alias("name"), p["description"].alias("description"),
        p["brand"].alias("brand"), p["price"]["final"].alias("price_final"), p["price"]["regular"].alias("price_regular"),
        p["price"]["currency"].alias("currency"), p["availability"].alias("availability"),
        F.get(p["images"], 0)["url"].alias("image"))


@query("api_complex", """
WITH pr AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS ln,
                   arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS rf FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT 'P-' || CAST(l_partkey AS VARCHAR) AS sku, '/products/c-' || CAST(l_partkey AS VARCHAR) || '/p-' || CAST(l_partkey AS VARCHAR) AS path,
  'P-' || CAST(l_partkey AS VARCHAR) || '-S-' || CAST(l_suppkey AS VARCHAR) AS variant_sku,
  'color=' || split_part(p_name, ' ', 1) || '|size=' || CAST(ln AS VARCHAR) AS options,
  'cl-' || CAST(l_partkey AS VARCHAR) || '|sz-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(ln AS VARCHAR) AS uids,
  'https://cdn.example.com/' || CAST(l_partkey AS VARCHAR) || '.jpg' AS image,
  CASE WHEN rf = 'N' THEN 'InStock' ELSE 'OutOfStock' END AS availability,
  regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS price_final
FROM pr JOIN part ON pr.l_partkey = part.p_partkey
""")
def api_complex(spark, sf_dir):
    """N1, N6-N8 on complex views (options by selection UID, parent image
    fallback), then T10/T11 and V1; one row per variant."""
    from ..operators.api import normalize_product, source_url
    from ..operators.transform import transform_product
    views = S.api_complex_views(spark, sf_dir)
    raw = views.select(once(normalize_product(F.col("pv"), F.col("variants"), API_BASE)).alias("raw"),
                       source_url(F.col("pv"), API_BASE).alias("_src"))
    raw = raw.select("raw", F.coalesce(F.col("raw.url"), F.col("_src")).alias("src"))
    t = raw.select(once(transform_product(F.col("raw"), F.col("src"))).alias("t")).select("t.product")
    v = t.filter(F.col("product").isNotNull()).select(
        F.col("product.sku").alias("sku"), F.col("product.path").alias("path"), F.explode("product.variants").alias("v"))
    return v.select("sku", "path", F.col("v.sku").alias("variant_sku"),
                    F.array_join(F.transform("v.options", lambda o: F.concat(o["id"], F.lit("="), o["value"])), "|")
                    .alias("options"),
                    F.array_join(F.transform("v.options", lambda o: o["uid"]), "|").alias("uids"),
                    F.get(F.col("v.images"), 0)["url"].alias("image"), F.col("v.availability").alias("availability"),
                    F.col("v.price.final").alias("price_final"))


@query("product_files", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE p_partkey % 6 = 0) AS BIGINT) AS valid,
       CAST(count(*) FILTER (WHERE p_partkey % 6 <> 0) AS BIGINT) AS skipped
FROM part
""")
def product_files(spark, sf_dir):
    """S11 sink of every part product (faults injected as in validation_errors),
    S10 recursive scan of the written files, V4 dry-run report."""
    import os
    import uuid

    from ..operators.validate import dry_run_report
    from ..session import checkpoint_dir
    from ..sources.products import scan_products, write_products
    prods = validation_errors_products(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), "products", uuid.uuid4().hex)
    write_products(prods, path)
    summary, _reasons = dry_run_report(scan_products(spark, path))
    return summary.select(F.col("total").cast("long"), F.col("valid").cast("long"), F.col("skipped").cast("long"))


LISTING_PAGE_SIZE = 50
DETAIL_BATCH = 20


@query("api_listing", f"""
WITH items AS (SELECT p_partkey, p_name, p_size, p_partkey // {LISTING_PAGE_SIZE} + 1 AS page FROM part),
listed AS (SELECT * FROM items WHERE p_size % 17 <> 0)
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ' v2' ELSE p_name END AS name,
  split_part(p_name, ' ', 2) || '-' || CAST(p_partkey AS VARCHAR) AS url_key
FROM listed
""")
def api_listing(spark, sf_dir):
    """S7 listing scan (NULL items skipped, every page) and
    S8 detail scan (duplicate SKUs across batches: last response wins),
    joined on SKU (N9)."""
    import os
    import uuid

    from ..operators.api import join_details
    from ..session import checkpoint_dir
    from ..sources.api_responses import scan_details, scan_listing
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    base = os.path.join(checkpoint_dir(spark), "api", uuid.uuid4().hex)
    # listing responses: pages of 50; some items carry a NULL productView
    item = F.struct(F.when(F.col("p_size") % 17 != 0, F.struct(
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("name"),
        F.concat(F.split("p_name", " ").getItem(1), F.lit("-"), F.col("p_partkey").cast("string")).alias("urlKey"),
        F.lit("SimpleProductView").alias("__typename"))).alias("productView"))
    pages = part.groupBy((F.floor(F.col("p_partkey") / LISTING_PAGE_SIZE) + 1).cast("int").alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("it")))), lambda x: x["it"]).alias("items"))
    pages.select(F.struct(F.struct("items", F.struct(F.col("page").alias("current_page"),
                                                     F.lit(LISTING_PAGE_SIZE).alias("page_size"))
                                   .alias("page_info")).alias("productSearch")).alias("data")) \
        .write.mode("overwrite").json(os.path.join(base, "listing"))
    # detail responses in batches of 20; every third product appears again in a later batch, renamed
    views = part.select((F.floor(F.col("p_partkey") / DETAIL_BATCH)).alias("batch"), F.struct(
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("name")).alias("p"))
    again = part.filter(F.col("p_partkey") % 3 == 0).select(
        (F.floor(F.col("p_partkey") / DETAIL_BATCH) + 1000000).alias("batch"), F.struct(
            F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.concat(F.col("p_name"), F.lit(" v2")).alias("name")).alias("p"))
    views.unionByName(again).groupBy("batch").agg(F.collect_list("p").alias("products")) \
        .select("batch", F.struct("products").alias("data")).write.mode("overwrite").json(os.path.join(base, "details"))
    listing = scan_listing(spark, os.path.join(base, "listing")).select("sku", "urlKey")
    details = scan_details(spark, os.path.join(base, "details"))
    found, _missing = join_details(listing, details)
    return found.select("sku", F.col("pv.name").alias("name"), F.col("urlKey").alias("url_key"))


@query("api_variant_scan", """
WITH pr AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT 'P-' || CAST(l_partkey AS VARCHAR) AS sku,
  CAST(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS n_variants
FROM pr GROUP BY l_partkey
""")
def api_variant_scan(spark, sf_dir):
    """Variant responses per complex product (some without a variant
    list) scanned back; missing lists become empty."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..sources.api_responses import scan_variants
    views = S.api_complex_views(spark, sf_dir)
    sku = F.col("pv.sku")
    key = F.regexp_extract(sku, r"^P-(\d+)$", 1).cast("long")
    resp = views.select(sku.alias("sku"), F.struct(F.when(key % 5 != 0, F.struct(F.col("variants").alias("variants")))
                                                   .alias("variants")).alias("data"))
    path = os.path.join(checkpoint_dir(spark), "variants", uuid.uuid4().hex)
    resp.write.mode("overwrite").json(path)
    got = scan_variants(spark, path)
    return got.select("sku", F.size("variants").cast("int").alias("n_variants"))


@query("batch_validation", """
SELECT CAST(count(*) FILTER (WHERE p_partkey % 6 = 0) AS BIGINT) AS n_valid,
       CAST(count(*) FILTER (WHERE p_partkey % 6 <> 0) AS BIGINT) AS n_invalid,
       bool_and(p_partkey % 6 = 0) AS valid
FROM part
""")
def batch_validation(spark, sf_dir):
    """V2: per-record (index, valid, errors) and the overall batch flag."""
    from ..operators.validate import validate_batch
    p = validation_errors_products(spark, sf_dir)
    per = validate_batch(p.select(F.struct(*[F.col(c) for c in p.columns]).alias("product"),
                                  F.col("sku").alias("index")))
    # one pass: counts and the batch flag (the bool_and of batch_valid)
    return per.agg(F.count_if("valid").cast("long").alias("n_valid"),
                   F.count_if(~F.col("valid")).cast("long").alias("n_invalid"),
                   F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"))
