"""E19 JSON-LD/HTML merge, E20 reject rule, E23 variant source precedence,
and the page extractor chaining E0-E23 into one narrow plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keep_one, let, once
from ..schemas import IMAGE
from .fields import with_fields
from .html import extract_html, is_soft_404, product_fields
from .platforms import PLATFORMS, VARIANT_JSON, platform_config
from .structured import with_embedded, with_jsonld

_ARR_IMAGE = f"array<{IMAGE.simpleString()}>"


def merge_sources(jl: Column, h: Column) -> Column:
    """JSON-LD fields win when not NULL; prices merge field by field;
    images are JSON-LD first then HTML, de-duplicated by URL."""
    def pick(name):
        return F.coalesce(jl[name], h[name])

    jl_price, h_price = jl["price"], h["price"]
    price = F.when(jl_price.isNotNull() & h_price.isNotNull(), F.struct(
        F.coalesce(jl_price["currency"], h_price["currency"]).alias("currency"),
        F.coalesce(jl_price["regular"], h_price["regular"]).alias("regular"),
        F.coalesce(jl_price["final"], h_price["final"]).alias("final"),
    )).otherwise(F.coalesce(jl_price, h_price))
    all_imgs = F.filter(F.concat(F.coalesce(jl["images"], F.array().cast(_ARR_IMAGE)),
                                 F.coalesce(h["images"], F.array().cast(_ARR_IMAGE))),
                        lambda i: i["url"].isNotNull() & (i["url"] != ""))

    def dedup(arr):
        return F.when(F.size(arr) > 0, keep_one(arr, lambda i: i["url"])).otherwise(h["images"])
    merged = F.struct(
        pick("name").alias("name"), pick("sku").alias("sku"), pick("url").alias("url"),
        pick("description").alias("description"), pick("brand").alias("brand"), pick("gtin").alias("gtin"),
        h["metaTitle"].alias("metaTitle"), h["metaDescription"].alias("metaDescription"),
        pick("availability").alias("availability"), pick("itemCondition").alias("itemCondition"),
        price.alias("price"), let(all_imgs, dedup).alias("images"),
        jl["aggregateRating"].alias("aggregateRating"), jl["variants"].alias("variants"),
    )
    return F.when(jl.isNull(), h).otherwise(merged)


def is_rejected(raw: Column) -> Column:
    """Neither a name nor a SKU -> no product."""
    return ~(F.coalesce(raw["name"] != "", F.lit(False)) | F.coalesce(raw["sku"] != "", F.lit(False)))


def page_fields(pages: DataFrame, platform: str | None = "generic", url_col: str = "url", html_col: str = "html",
                platform_col: str = "platform") -> DataFrame:
    """The page's columns (without its HTML), ``soft_404``, the
    HTML fields ``_h`` and the texts of its JSON-LD (``scripts``) and embedded
    variant JSON (``variant_texts``).  With ``platform`` None every row is read
    with the selectors of its ``platform_col``, all in one stage."""
    rules = {p: product_fields(platform_config(p), VARIANT_JSON.get(p)) for p in ([platform] if platform else PLATFORMS)}
    read = with_fields(pages, rules, None if platform else platform_col, html_col)
    return read.select(*[c for c in pages.columns if c != html_col],
                       is_soft_404(F.get("f_page", 0), F.get("f_page", 1)).alias("soft_404"),
                       extract_html(F.col(url_col)).alias("_h"), "scripts", "variant_texts")


def merge_fields(fields: DataFrame, embedded: bool = True) -> DataFrame:
    """E4-E13, E19-E23 on ``page_fields``: adds ``raw`` (merged raw product, NULL
    for soft 404s) and ``rejected``; embedded variants win (E23)."""
    keep = [c for c in fields.columns if c not in ("_h", "scripts", "variant_texts")]
    staged = with_jsonld(fields)
    raw = merge_sources(F.col("jsonld"), F.col("_h"))
    if embedded:
        staged = with_embedded(staged)
        raw = let(raw, lambda m: m.withField("variants", F.coalesce(F.col("embedded"), m["variants"])))
    out = staged.select(*keep, once(F.when(~F.col("soft_404"), raw)).alias("raw"))
    return out.withColumn("rejected", F.col("soft_404") | is_rejected(F.col("raw")))


def extract_pages(pages: DataFrame, platform: str = "generic", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """E0-E23 for every page of one platform: ``page_fields`` and
    ``merge_fields``, one ``mapInArrow`` and narrow projections; no shuffle."""
    return merge_fields(page_fields(pages, platform, url_col, html_col), platform in VARIANT_JSON)
