"""Stand-in inputs built from the driver tables.

Each builder only renders rows in the schema an operator expects (product
records, variant records, robots files, crawl outcomes); none of them does
the operator's work.  They read whole tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import product_path
from ..sources.tables import read_table

STORE = "https://store.example.com"


def part_word(i: int):
    return F.split(F.col("p_name"), " ").getItem(i)


#: Parts to a task where a page or a record is rendered and read for each.
PARTS_A_TASK = 10_000

#: Lines to a task where a page or a product is rendered from the lines of a part.
LINES_A_TASK = 100_000


def _parts(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``part`` in tasks of about ``PARTS_A_TASK`` rows: its file is
    small for its rows, so a scan has few tasks, whatever is done for each row."""
    part = read_table(spark, sf_dir, "part").select(*columns)
    return part.repartition(-(-part.count() // PARTS_A_TASK) or 1)


PRODUCT_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def part_products(spark, sf_dir: str) -> DataFrame:
    """Product records (PRODUCT subset) for every part."""
    return _products(read_table(spark, sf_dir, "part").select(*PRODUCT_COLUMNS))


def _products(part: DataFrame, *more: Column) -> DataFrame:
    url = F.concat(F.lit(STORE + "/"), part_word(1), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".html"))
    return part.select(
        "p_partkey", "p_name", "p_type", "p_size", "p_retailprice",
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"), url.alias("url"), product_path(url).alias("path"),
        F.col("p_brand").alias("brand"),
        F.struct(F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("regular"),
                 F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("final")).alias("price"),
        F.lit("InStock").alias("availability"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("metaTitle"),
        F.lit(None).cast("string").alias("metaDescription"),
        F.lit(None).cast("array<struct<url:string,label:string,roles:array<string>>>").alias("images"),
        F.lit(None).cast("struct<categories:array<string>,related:array<string>>").alias("custom"), *more)


def _variant(part: Column, supplier: Column, line: Column) -> Column:
    """Variant record of a (part, supplier) pair and its line, beside the part's columns."""
    key, supp = part.cast("string"), supplier.cast("string")
    avail = F.when(line["l_returnflag"] == "N", F.lit("InStock")) \
        .when(line["l_returnflag"] == "A", F.lit("OutOfStock"))
    return F.struct(
        F.concat(F.lit("P-"), key, F.lit("-S-"), supp).alias("sku"),
        F.col("p_name").alias("name"),
        F.concat(F.lit(STORE + "/"), part_word(1), F.lit("/"), key, F.lit(".html?supplier="), supp).alias("url"),
        F.lit(None).cast("array<struct<url:string,label:string,roles:array<string>>>").alias("images"),
        F.struct(F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("regular"),
                 F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("final")).alias("price"),
        avail.alias("availability"),
        F.array(F.struct(F.lit("size").alias("id"), line["l_linenumber"].cast("string").alias("value"),
                         F.concat(F.lit("S"), supp).alias("uid")),
                F.struct(F.lit("color").alias("id"), part_word(0).alias("value"),
                         F.concat(F.lit("C"), supp).alias("uid"))).alias("options"))


def lineitem_variants(spark, sf_dir: str) -> DataFrame:
    """Exploded variant records (parent_sku, v) from distinct (part, supplier)
    pairs of lineitem; the representative line is the smallest
    (l_orderkey, l_linenumber), a total order."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                      "l_returnflag")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(
        F.min_by(F.struct("l_linenumber", "l_returnflag"), F.struct("l_orderkey", "l_linenumber")).alias("r"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = pairs.join(part, pairs.l_partkey == part.p_partkey)
    v = _variant(F.col("l_partkey"), F.col("l_suppkey"), F.col("r"))
    return j.select(F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("parent_sku"), v.alias("v"),
                    "l_partkey", "l_suppkey")


def _pairs_by_part(spark, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) pairs of lineitem with their representative
    line ``r`` (as ``lineitem_variants``), for builders that gather the pairs of
    a part: lines are dealt by part over tasks of about ``LINES_A_TASK``, so
    pairs, join and lists need one shuffle."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                      "l_returnflag")
    tasks = -(-li.count() // LINES_A_TASK) or 1
    return li.filter(F.col("l_partkey").isNotNull()).repartition(tasks, "l_partkey").groupBy("l_partkey", "l_suppkey").agg(
        F.min_by(F.struct("l_linenumber", "l_returnflag"), F.struct("l_orderkey", "l_linenumber")).alias("r"))


def products_with_variants(spark, sf_dir: str) -> DataFrame:
    """``part_products`` with the records of ``lineitem_variants`` as ``variants``, in SKU order."""
    lists = _pairs_by_part(spark, sf_dir).groupBy("l_partkey").agg(F.collect_list(F.struct("l_suppkey", "r")).alias("pairs"))
    part = read_table(spark, sf_dir, "part").select(*PRODUCT_COLUMNS)
    variants = F.transform("pairs", lambda x: _variant(F.col("p_partkey"), x["l_suppkey"], x["r"]))
    return _products(part.join(lists, F.col("p_partkey") == F.col("l_partkey"), "left"), F.sort_array(variants).alias("variants"))


def robots_files(spark, sf_dir: str) -> DataFrame:
    """One robots.txt per site origin found in pages."""
    from ..functions.urls import url_origin
    pages = read_table(spark, sf_dir, "pages").select("url")
    origins = pages.select(url_origin("url").alias("origin")).distinct()
    text = F.concat(F.lit("User-agent: badbot\nDisallow: /\n\n# main rules\nUser-agent: *\nDisallow: /de/\n"
                          "Allow: /de/1\n  Disallow: /fr/9  \nCrawl-delay: 2.5\nSitemap: "),
                    F.col("origin"), F.lit("/sitemap.xml\n"))
    return origins.select("origin", text.alias("text"))


def crawl_events(spark, sf_dir: str) -> DataFrame:
    """Crawl outcomes from events: key per user, status per event type."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    status = (F.when(F.col("event_type") == "signup", F.lit("discovered"))
              .when(F.col("event_type").isin("view", "purchase"), F.lit("crawled"))
              .when(F.col("event_type") == "error", F.lit("failed"))
              .when(F.col("event_type") == "click", F.lit("skipped")))
    error = (F.when(F.col("event_type") == "error", F.concat(F.lit("error event "), F.col("event_id").cast("string")))
             .when(F.col("event_type") == "click", F.lit("No product data found")))
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
                     F.struct("ts", "event_id").alias("seq"), F.col("event_id"),
                     status.alias("status"), error.alias("error"), F.col("ts").alias("at"))


def jsonld_pages(spark, sf_dir: str) -> DataFrame:
    """One product page per part with a schema.org JSON-LD block (rendered
    with ``to_json``) and a plain <h1>; no values are precomputed for the
    extractor, which has to parse the page and the JSON."""
    part = _parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    k = F.col("p_partkey").cast("string")
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"),
        F.col("p_name").alias("name"), F.concat(F.lit("P-"), k).alias("sku"),
        F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
        F.lpad(k, 13, "0").alias("gtin13"),
        F.array(F.concat(F.lit(STORE + "/img/"), k, F.lit(".jpg"))).alias("image"),
        F.struct(F.lit("Offer").alias("@type"), F.col("p_retailprice").alias("price"),
                 F.lit("usd").alias("priceCurrency"),
                 F.when(F.col("p_size") % 2 == 0, F.lit("https://schema.org/InStock"))
                 .otherwise(F.lit("https://schema.org/OutOfStock")).alias("availability")).alias("offers"),
        F.struct(F.lit("AggregateRating").alias("@type"), (F.col("p_size") % 5 + 1).alias("ratingValue"),
                 F.col("p_size").alias("ratingCount")).alias("aggregateRating"))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), F.col("p_name"),
                    F.lit("</title><script type=\"application/ld+json\">"), F.to_json(doc),
                    F.lit("</script></head><body><h1>"), F.col("p_name"), F.lit("</h1></body></html>"))
    url = F.concat(F.lit(STORE + "/"), part_word(1), F.lit("/"), k, F.lit(".html"))
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def api_simple_views(spark, sf_dir: str) -> DataFrame:
    """SimpleProductView records (schemas.API_PRODUCT) for every part."""
    from ..schemas import API_PRODUCT
    part = _parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    k = F.col("p_partkey").cast("string")
    money = lambda v: F.struct(F.struct(v.alias("value"), F.lit("USD").alias("currency")).alias("amount"))  # noqa
    price = F.col("p_retailprice").cast("decimal(18,2)")
    pv = F.struct(
        F.lit("SimpleProductView").alias("__typename"), F.concat(F.lit("P-"), k).alias("sku"),
        F.col("p_name").alias("name"), F.concat(part_word(1), F.lit("-"), k).alias("urlKey"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("<p>"), F.col("p_name"), F.lit(" by <b>"), F.col("p_brand"), F.lit("</b></p>")).alias("description"),
        F.lit(None).cast("string").alias("metaTitle"), F.lit(None).cast("string").alias("metaDescription"),
        F.when(F.col("p_size") % 3 == 1, F.lit(True)).when(F.col("p_size") % 3 == 2, F.lit(False)).alias("inStock"),
        F.array(F.struct(F.concat(F.lit("//cdn.example.com/"), k, F.lit(".jpg")).alias("url"),
                         F.col("p_name").alias("label"), F.array(F.lit("image"), F.lit("small_image")).alias("roles")))
        .alias("images"),
        F.array(F.struct(F.lit("brand").alias("name"), F.lit("Brand").alias("label"), F.col("p_brand").alias("value"),
                         F.lit(None).cast("array<string>").alias("roles")),
                F.struct(F.lit("color").alias("name"), F.lit("Color").alias("label"), part_word(0).alias("value"),
                         F.lit(None).cast("array<string>").alias("roles"))).alias("attributes"),
        F.struct(money(price).alias("final"), money(price + 10).alias("regular")).alias("price"),
        F.lit(None).alias("priceRange"), F.lit(None).alias("options"))
    return part.select("p_partkey", pv.cast(API_PRODUCT).alias("pv"))


def api_complex_views(spark, sf_dir: str) -> DataFrame:
    """ComplexProductView records with option values and variants (selections
    listed color first, size second) for every part with lineitem pairs."""
    from pyspark.sql.types import ArrayType

    from ..schemas import API_PRODUCT, API_VARIANT
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                      "l_returnflag")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(
        F.min_by(F.struct("l_linenumber", "l_returnflag"), F.struct("l_orderkey", "l_linenumber")).alias("r"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = pairs.join(part, pairs.l_partkey == part.p_partkey)
    k, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    ln = F.col("r.l_linenumber").cast("string")
    money = lambda v: F.struct(F.struct(v.alias("value"), F.lit("USD").alias("currency")).alias("amount"))  # noqa
    price = F.col("p_retailprice").cast("decimal(18,2)")
    variant = F.struct(
        F.array(F.concat(F.lit("cl-"), k), F.concat(F.lit("sz-"), k, F.lit("-"), ln)).alias("selections"),
        F.struct(F.concat(F.lit("P-"), k, F.lit("-S-"), s).alias("sku"),
                 F.concat(F.col("p_name"), F.lit(" S"), s).alias("name"),
                 (F.col("r.l_returnflag") == "N").alias("inStock"),
                 F.lit(None).alias("images"),
                 F.struct(money(price).alias("final"), F.lit(None).alias("regular")).alias("price")).alias("product"))
    per = j.groupBy("l_partkey", "p_name", "p_retailprice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", variant.alias("v")))), lambda x: x["v"])
        .alias("variants"),
        F.array_sort(F.collect_set(F.col("r.l_linenumber"))).alias("sizes"))
    k2 = F.col("l_partkey").cast("string")
    options = F.array(
        F.struct(F.lit("size").alias("id"), F.lit("Size").alias("title"),
                 F.transform("sizes", lambda z: F.struct(F.concat(F.lit("sz-"), k2, F.lit("-"), z.cast("string")).alias("id"),
                                                         z.cast("string").alias("title"),
                                                         F.lit(True).alias("inStock"))).alias("values")),
        F.struct(F.lit("color").alias("id"), F.lit("Color").alias("title"),
                 F.array(F.struct(F.concat(F.lit("cl-"), k2).alias("id"),
                                  F.split("p_name", " ").getItem(0).alias("title"),
                                  F.lit(True).alias("inStock"))).alias("values")))
    pr = F.col("p_retailprice").cast("decimal(18,2)")
    pv = F.struct(
        F.lit("ComplexProductView").alias("__typename"), F.concat(F.lit("P-"), k2).alias("sku"),
        F.col("p_name").alias("name"), F.concat(F.lit("c-"), k2).alias("urlKey"), F.lit(None).alias("url"),
        F.lit(None).alias("description"), F.lit(None).alias("metaTitle"), F.lit(None).alias("metaDescription"),
        F.lit(True).alias("inStock"),
        F.array(F.struct(F.concat(F.lit("//cdn.example.com/"), k2, F.lit(".jpg")).alias("url"),
                         F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("roles")))
        .alias("images"),
        F.lit(None).alias("attributes"), F.lit(None).alias("price"),
        F.struct(F.struct(money(pr).alias("final"), F.lit(None).alias("regular")).alias("minimum"),
                 F.lit(None).alias("maximum")).alias("priceRange"),
        options.alias("options"))
    return per.select(pv.cast(API_PRODUCT).alias("pv"), F.col("variants").cast(ArrayType(API_VARIANT)).alias("variants"))


SITEMAP_BUCKETS = 4


def _xml_escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def sitemap_docs(spark, sf_dir: str) -> DataFrame:
    """Sitemap documents per site: an index at /sitemap.xml pointing to
    bucketed child url sets (pages of the site split by page id)."""
    from ..functions.urls import url_origin
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url").withColumn("origin", url_origin("url"))
    pages = pages.withColumn("b", F.pmod(F.col("page_id"), F.lit(SITEMAP_BUCKETS)))
    child_url = F.concat("origin", F.lit("/sitemap-"), F.col("b").cast("string"), F.lit(".xml"))
    ns = '<?xml version="1.0" encoding="UTF-8"?>'
    children = pages.groupBy("origin", "b").agg(F.array_sort(F.collect_list("url")).alias("urls")).select(
        "origin", child_url.alias("url"),
        F.concat(F.lit(ns + '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                 F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url><loc>"), _xml_escape(u),
                                                                     F.lit("</loc></url>"))), ""),
                 F.lit("</urlset>")).alias("xml"))
    index = children.groupBy("origin").agg(F.array_sort(F.collect_list("url")).alias("kids")).select(
        "origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"),
        F.concat(F.lit(ns + '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                 F.array_join(F.transform("kids", lambda u: F.concat(F.lit("<sitemap><loc>"), _xml_escape(u),
                                                                     F.lit("</loc></sitemap>"))), ""),
                 F.lit("</sitemapindex>")).alias("xml"))
    return index.unionByName(children)


def listing_pages(spark, sf_dir: str) -> DataFrame:
    """Listing pages: each page links to the next page of its site (by page
    id) with rel=next; the last page of a site links to itself when its id is
    even, else has no next link."""
    from pyspark.sql import Window

    from ..functions.urls import url_origin
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url").withColumn("origin", url_origin("url"))
    nxt = F.lead("url").over(Window.partitionBy("origin").orderBy("page_id"))
    pages = pages.withColumn("nxt", F.coalesce(nxt, F.when(F.col("page_id") % 2 == 0, F.col("url"))))
    link = F.when(F.col("nxt").isNotNull(), F.concat(F.lit('<a class="pager" rel="next" href="'),
                                                      F.regexp_replace("nxt", "&", "&amp;"), F.lit('">Next</a>')))
    html = F.concat(F.lit("<html><body><div class=\"list\"><a href=\"/p/1\">p</a></div><nav>"),
                    F.coalesce(link, F.lit("")), F.lit("</nav></body></html>"))
    return pages.select("page_id", "url", "origin", html.alias("html"))


def shopify_pages(spark, sf_dir: str) -> DataFrame:
    """Product pages carrying Shopify-style embedded product JSON (variants
    priced in cents, image by id) rendered from part and lineitem pairs."""
    pairs = _pairs_by_part(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = pairs.join(part, pairs.l_partkey == part.p_partkey)
    k, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    v = F.struct(
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"),
        F.concat(F.lit("P-"), k, F.lit("-S-"), s).alias("sku"),
        F.concat(F.col("p_name"), F.lit(" / "), F.col("r.l_linenumber").cast("string")).alias("title"),
        cents.alias("price"),
        F.when(F.col("l_suppkey") % 2 == 0, cents + 1000).alias("compare_at_price"),
        (F.col("r.l_returnflag") == "N").alias("available"),
        F.col("r.l_linenumber").cast("string").alias("option1"),
        F.split("p_name", " ").getItem(0).alias("option2"),
        F.col("l_partkey").alias("image_id"))
    per = j.groupBy("l_partkey", "p_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", v.alias("v")))), lambda x: x["v"]).alias("vs"))
    k2 = F.col("l_partkey").cast("string")
    doc = F.struct(F.struct(F.col("p_name").alias("title"),
                            F.array(F.struct(F.lit("Size").alias("name")), F.struct(F.lit("Color").alias("name")))
                            .alias("options"),
                            F.array(F.struct(F.col("l_partkey").alias("id"),
                                             F.concat(F.lit("https://cdn.example.com/"), k2, F.lit(".jpg")).alias("src")))
                            .alias("images"),
                            F.col("vs").alias("variants")).alias("product"))
    html = F.concat(F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title></head><body><h1>"), F.col("p_name"),
                    F.lit('</h1><script type="application/json" data-product-json>'),
                    F.regexp_replace(F.to_json(doc), "</", "<\\\\/"), F.lit("</script></body></html>"))
    url = F.concat(F.lit(STORE + "/products/"), k2)
    return per.select(F.col("l_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def mixed_pages(spark, sf_dir: str) -> DataFrame:
    """Pages with HTML product fields for every part and, for even keys, a
    partial JSON-LD block (name, offer price/currency, image)."""
    part = _parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_retailprice")
    k = F.col("p_partkey").cast("string")
    doc = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"),
                   F.struct(F.col("p_retailprice").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"),
                   F.concat(F.lit("https://cdn.example.com/"), k, F.lit("-a.jpg")).alias("image"))
    ld = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), F.to_json(doc),
                                                       F.lit("</script>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title>"), ld, F.lit("</head><body>"),
        F.lit('<h1 class="product-title">'), F.col("p_name"), F.lit(" (html)</h1>"),
        F.lit('<span itemprop="price">€'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("</span>"),
        F.lit('<div class="product-description"><p>Desc '), F.col("p_brand"), F.lit("</p></div>"),
        F.lit('<span class="sku">SKU-'), k, F.lit('</span><span class="brand">'), F.col("p_brand"), F.lit("</span>"),
        F.lit('<img class="product-image" src="/img/'), k, F.lit('-b.jpg" alt="'), F.col("p_name"),
        F.lit('"></body></html>'))
    url = F.concat(F.lit(STORE + "/item/"), k)
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def shop_pages(spark, sf_dir: str) -> DataFrame:
    """Pages of five shops, one on each platform: a homepage with the platform's
    mark, and a product page for each part in the platform's markup, below a
    heading that is not the product's."""
    part = _parts(spark, sf_dir, "p_partkey", "p_name", "p_retailprice")
    shop = F.col("p_partkey") % 5
    price = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))

    def page(title, cost):
        return F.concat(F.lit(f"<html><body><h1>Shop</h1><div><{title}>"), F.col("p_name"), F.lit(f"</{title.split(' ')[0]}>"),
                        F.lit(f"<p {cost}>"), price, F.lit("</p></div></body></html>"))
    markup = [page('h2 class="product__title"', 'class="product__price"'), page('h2 class="page-title-wrapper"', 'class="none"'),
              page('h2 class="productView-title"', 'data-product-price-without-tax'),
              page('h2 class="product_title"', 'class="woocommerce-Price-amount"'), page('h2 itemprop="none"', 'class="price"')]
    markup[1] = F.concat(F.lit('<html><body><h1>Shop</h1><h1 class="page-title"><span>'), F.col("p_name"),
                         F.lit('</span></h1><div class="price-box"><b class="price">'), price, F.lit("</b></div></body></html>"))
    markup[4] = F.concat(F.lit('<html><body><h1>Shop</h1><h1 class="product-name">'), F.col("p_name"),
                         F.lit('</h1><b class="price">'), price, F.lit("</b></body></html>"))
    html = F.when(shop == 0, markup[0])
    for k in range(1, 5):
        html = html.when(shop == k, markup[k])
    url = F.concat(F.lit("https://shop"), shop.cast("string"), F.lit(".example.com/p/"), F.col("p_partkey").cast("string"))
    marks = ["cdn.shopify.com", "window.Mage = 1", "window.BCData = 1", "wc_cart_params", "plain"]
    homes = part.select((F.col("p_partkey") % 5).alias("k")).distinct().select(
        F.lit(None).cast("long").alias("page_id"),
        F.concat(F.lit("https://shop"), F.col("k").cast("string"), F.lit(".example.com/")).alias("url"),
        F.concat(F.lit("<html><body><h1>Home</h1><script>"), F.element_at(F.array(*map(F.lit, marks)), (F.col("k") + 1).cast("int")),
                 F.lit("</script></body></html>")).alias("html"))
    return part.select(F.col("p_partkey").cast("long").alias("page_id"), url.alias("url"), html.alias("html")).unionByName(homes)


def category_pages(spark, sf_dir: str) -> DataFrame:
    """Listing pages of ten parts each, ten listings to a category: product
    links (one twice, one with a query), other links, and the next page."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    n = F.floor(F.col("p_partkey") / 10)
    link = F.concat(F.lit('<a href="/products/'), F.col("p_partkey").cast("string"), F.lit('?ref=1">x</a><a href="/products/'),
                    F.col("p_partkey").cast("string"), F.lit('#top">y</a>'))
    body = part.groupBy(n.alias("n")).agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("links"))
    body = body.withColumn("category", F.floor(F.col("n") / 10))
    here = lambda n: F.concat(F.lit("https://store.example.com/c/"), n.cast("string"))
    nxt = F.when(F.col("n") % 10 < 9, F.concat(F.lit('<a rel="next" href="/c/'), (F.col("n") + 1).cast("string"), F.lit('">next</a>')))
    html = F.concat(F.lit('<html><body><a href="/about">a</a><a href="mailto:x@y">m</a>'), F.col("links"), F.coalesce(nxt, F.lit("")),
                    F.lit("</body></html>"))
    return body.select("n", "category", here(F.col("n")).alias("url"), html.alias("html"))


SHOP_SIZE = 50


def shop_urls(spark, sf_dir: str) -> DataFrame:
    """A URL for each part, fifty to a shop (origin); shops of four kinds ``k``
    and five platforms.  Every third part's URL is no product page."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    shop = F.floor(F.col("p_partkey") / SHOP_SIZE)
    word = F.element_at(F.array(*map(F.lit, ["/products/", "/product/", "/about/"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    origin = F.concat(F.lit("https://shop"), shop.cast("string"), F.lit(".example.com"))
    names = F.array(*map(F.lit, ["generic", "shopify", "magento", "bigcommerce", "woocommerce"]))
    return part.select("p_partkey", shop.alias("shop"), (shop % 4).alias("k"), origin.alias("origin"),
                       F.element_at(names, (shop % 5 + 1).cast("int")).alias("platform"),
                       F.concat(origin, word, F.col("p_partkey").cast("string"), F.lit(".html")).alias("url"))


def shop_discovery(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Origins, robots files and sitemaps of ``shop_urls``, by kind of shop:
    0: robots lists an index of two lists, then a list of all URLs backwards;
    1: robots lists none, the first common location leads nowhere, the second
    to a list, a third is not looked at; 2: no robots file; 3: robots lists a
    sitemap that is not there, and another is not looked at."""
    urls = shop_urls(spark, sf_dir)
    origins = urls.select("origin", "platform", "k").distinct()
    at = lambda path: F.concat("origin", F.lit(path))
    rules = "User-agent: *\nDisallow: /products/1\nAllow: /products/12\nDisallow: /product/3\n"
    robots = origins.filter("k <> 2").select("origin", F.when(
        F.col("k") == 0, F.concat(F.lit(rules + "Sitemap: "), at("/b.xml"), F.lit("\nSitemap: "), at("/a.xml")))
        .when(F.col("k") == 1, F.lit(rules)).otherwise(F.concat(F.lit("Sitemap: "), at("/gone.xml"))).alias("text"))
    some = lambda x: F.concat(F.lit("<url><loc>"), x, F.lit("</loc></url>"))

    def listed(of, path, order=F.col("p_partkey")):
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), some(F.col("url")).alias("x")))),
                                        lambda e: e["x"]), "")
        return of.groupBy("origin").agg(body.alias("b")).select(
            at(path).alias("url"), F.concat(F.lit("<urlset>"), F.col("b"), F.lit("</urlset>")).alias("xml"))

    def index(kind, path, *kids):
        child = F.concat(*[F.concat(F.lit("<sitemap><loc>"), at(x), F.lit("</loc></sitemap>")) for x in kids])
        return origins.filter(f"k = {kind}").select(at(path).alias("url"), F.concat(F.lit("<sitemapindex>"), child, F.lit("</sitemapindex>")).alias("xml"))
    k = lambda n: urls.filter(f"k = {n}")
    docs = [index(0, "/b.xml", "/b0.xml", "/b1.xml"), listed(k(0).filter("p_partkey % 2 = 0"), "/b0.xml"),
            listed(k(0).filter("p_partkey % 2 = 1 AND p_partkey % 7 = 0"), "/b1.xml"), listed(k(0), "/a.xml", -F.col("p_partkey")),
            index(1, "/sitemap.xml", "/gone.xml"), index(1, "/sitemap_index.xml", "/all.xml", "/sitemap_index.xml"),
            listed(k(1), "/all.xml"), listed(k(1).withColumn("url", F.concat("url", F.lit("?unused"))), "/sitemap-products.xml"),
            listed(k(2), "/product-sitemap.xml"), listed(k(3), "/sitemap.xml")]
    sitemaps = docs[0]
    for d in docs[1:]:
        sitemaps = sitemaps.unionByName(d)
    return origins.select("origin", "platform"), robots, sitemaps


def troubled_pages(spark, sf_dir: str) -> DataFrame:
    """A page for each part, in eight turns: sale price; soft 404 by title;
    soft 404 by text; no name; unknown availability; a URL without a valid
    path; only a sale price; neither name nor SKU."""
    part = _parts(spark, sf_dir, "p_partkey", "p_name", "p_retailprice")
    k, n = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    has = lambda cond, *text: F.when(cond, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>"), F.when(k == 1, F.lit("Error 404")).otherwise(F.lit("Shop")), F.lit("</title></head><body>"),
        has(~k.isin(3, 7), '<h1 class="product-name">', F.col("p_name"), "</h1>"),
        has(k != 7, '<span class="sku">S-', n, "</span>"),
        has(~k.isin(6), '<span itemprop="price">$', price, "</span>"),
        has(k.isin(0, 6), '<span class="was-price">$1', price, "</span>"),
        has(k == 4, '<span class="stock-status">Perhaps</span>'), has(k == 2, "<p>Sorry, Page Not Found.</p>"),
        F.lit("</body></html>"))
    path = F.when(k == 5, F.repeat(F.lit("a"), 1000)).otherwise(F.lit("item"))
    return part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(STORE + "/"), path, F.lit("/"), n).alias("url"), html.alias("html"))
