"""E14-E18 HTML fields and the S6 soft-404 test over the values that
``fields.with_fields`` reads from the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.prices import currency_from_symbol, parse_price
from ..functions.text import JS_WS, js_trim, keep_one, let
from ..functions.urls import resolve_url
from ..schemas import IMAGE, PRICE, RATING, VARIANT
from .fields import PageFields

# --- fixed values: selectors used on every platform --------------------------
SKU_ATTR_SELECTORS = ['[data-sku]']
BRAND_META_SELECTORS = ['meta[itemprop="brand"]', 'meta[property="product:brand"]']
AVAILABILITY_ATTR_SELECTORS = ['[itemprop="availability"]', 'link[itemprop="availability"]']
META_DESCRIPTION_SELECTORS = ['meta[name="description"]', 'meta[property="og:description"]']
IMAGE_SKIP_SUBSTRINGS = [".svg", "pixel", "tracking"]
SOFT_404_TITLE = ["404", "not found"]
SOFT_404_BODY = "page not found"
SOFT_404_MAX_BODY = 1000
JSONLD_SELECTOR = 'script[type="application/ld+json"]'
# ----------------------------------------------------------------------------


def product_fields(cfg: dict, variant_json: dict | None = None) -> PageFields:
    """What E14-E18 and S6 read from a page with one platform's selectors."""
    texts = lambda key: [(s, "text") for s in cfg.get(key, [])]
    attr = lambda selectors, name: [(s, "@" + name) for s in selectors]
    place = "text" if not variant_json or not variant_json["attribute"] else "@" + variant_json["attribute"]
    return PageFields(
        fields={
            "f_name": [(s, "text") for s in cfg.get("productTitle") or ["h1"]],
            "f_sku": texts("sku") + attr(SKU_ATTR_SELECTORS, "data-sku"),
            "f_description": [(s, "html") for s in cfg.get("description", [])],
            "f_brand": texts("brand") + attr(BRAND_META_SELECTORS, "content"),
            "f_meta": attr(META_DESCRIPTION_SELECTORS, "content"),
            "f_availability": texts("availability") + attr(AVAILABILITY_ATTR_SELECTORS, "content")
            + attr(AVAILABILITY_ATTR_SELECTORS, "href"),
            "f_price": texts("price"), "f_sale": texts("salePrice"), "f_currency": attr(cfg.get("currency", []), "content")},
        firsts={"f_page": [("title", "text"), ("body", f"text<{SOFT_404_MAX_BODY}")],
                "variant_texts": [(s, place) for s in (variant_json or {"selectors": []})["selectors"]]},
        lists={"f_images": (cfg.get("images", []), ["@src", "@data-src", "@data-srcset", "@alt"]),
               "scripts": ([JSONLD_SELECTOR], ["text"])})


def is_soft_404(title: Column, body: Column) -> Column:
    """Title mentions 404 / not found, or a short body (NULL: longer) says
    page not found."""
    heading = F.lower(F.coalesce(js_trim(F.regexp_replace(title, r"[\t\n\f\r ]+", " ")), F.lit("")))
    by_title = F.lit(False)
    for s in SOFT_404_TITLE:
        by_title = by_title | heading.contains(s)
    return by_title | F.coalesce(F.lower(body).contains(SOFT_404_BODY), F.lit(False))


def html_images(found: Column, page_url: Column) -> Column:
    """Image URLs (src, data-src, first data-srcset entry), absolutised,
    filtered, de-duplicated by URL keeping the first; alt -> label."""
    def nb(x):
        return F.when(x != "", x)

    def to_img(e):
        src = F.coalesce(nb(e["src"]), nb(e["data_src"]), nb(F.split_part(e["data_srcset"], F.lit(" "), F.lit(1))))
        return F.struct(resolve_url(src, page_url).alias("url"), nb(e["alt"]).alias("label"),
                        F.lit(None).cast("array<string>").alias("roles"))

    imgs = F.filter(F.transform(found, to_img), lambda i: i["url"].isNotNull()
                    & ~i["url"].startswith("data:")
                    & ~F.exists(F.array(*[F.lit(s) for s in IMAGE_SKIP_SUBSTRINGS]), lambda s: i["url"].contains(s)))
    return keep_one(imgs, lambda i: i["url"]).cast(f"array<{IMAGE.simpleString()}>")


def html_price(price_text: Column, sale_text: Column, currency: Column) -> Column:
    """E15 + E16 + E17: price text pair -> price struct."""
    both = price_text.isNotNull() & sale_text.isNotNull()
    return F.when(price_text.isNotNull() | sale_text.isNotNull(), F.struct(
        F.coalesce(currency, currency_from_symbol(price_text)).alias("currency"),
        F.when(both, parse_price(sale_text)).alias("regular"),
        F.when(price_text.isNotNull(), parse_price(price_text)).alias("final"),
    )).cast(PRICE)


def extract_html(page_url: Column) -> Column:
    """The page's values -> raw-product struct (JSON-LD-only fields NULL)."""
    c = F.col
    title = let(js_trim(F.get("f_page", 0)), lambda t: F.when(t != "", t))
    return F.struct(
        c("f_name").alias("name"), c("f_sku").alias("sku"), F.lit(None).cast("string").alias("url"),
        c("f_description").alias("description"), c("f_brand").alias("brand"), F.lit(None).cast("string").alias("gtin"),
        title.alias("metaTitle"), c("f_meta").alias("metaDescription"), c("f_availability").alias("availability"),
        F.lit(None).cast("string").alias("itemCondition"),
        html_price(c("f_price"), c("f_sale"), c("f_currency")).alias("price"),
        let(html_images(c("f_images"), page_url), lambda im: F.when(F.size(im) > 0, im)).alias("images"),
        F.lit(None).cast(RATING).alias("aggregateRating"),
        F.lit(None).cast(f"array<{VARIANT.simpleString()}>").alias("variants"),
    )


__all__ = ["extract_html", "is_soft_404", "html_images", "html_price", "product_fields", "JS_WS"]
