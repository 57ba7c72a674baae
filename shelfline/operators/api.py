"""Commerce API product views -> raw products (Catalyst only).

Input rows follow ``schemas.API_PRODUCT`` with the product's variants
(``schemas.API_VARIANT``) in the same row for complex products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, keep_one, let, strip_html
from ..schemas import IMAGE, RAW_PRODUCT

_ARR_IMAGE = f"array<{IMAGE.simpleString()}>"


def js_decimal_string(c: Column) -> Column:
    """``String(number)`` for a decimal column: no trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def image_url(u: Column) -> Column:
    """Protocol-relative URLs get ``https:``."""
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)


def _images(imgs: Column, with_roles: bool) -> Column:
    return F.transform(F.filter(imgs, lambda i: i["url"].isNotNull() & (i["url"] != "")), lambda i: F.struct(
        image_url(i["url"]).alias("url"), F.when(i["label"] != "", i["label"]).alias("label"),
        (F.when(F.size(i["roles"]) > 0, i["roles"]) if with_roles else F.lit(None).cast("array<string>"))
        .alias("roles")))


def extract_price(p: Column) -> Column:
    """final/regular amounts; currency from final, else regular."""
    fin, reg = p["final"]["amount"], p["regular"]["amount"]
    out = F.struct(F.coalesce(F.when(fin.isNotNull(), fin["currency"]),
                              F.when(reg.isNotNull(), reg["currency"])).alias("currency"),
                   F.when(reg.isNotNull(), js_decimal_string(reg["value"])).alias("regular"),
                   F.when(fin.isNotNull(), js_decimal_string(fin["value"])).alias("final"))
    return F.when(p.isNotNull() & (fin.isNotNull() | reg.isNotNull()), out)


def _availability(in_stock: Column) -> Column:
    return F.when(in_stock, F.lit("InStock")).when(~in_stock, F.lit("OutOfStock"))


def normalize_product(pv: Column, variants: Column, base_url: str | None) -> Column:
    """One product view (+ its variants) -> raw-product struct."""
    sku = js_trim(pv["sku"])
    url = F.coalesce(pv["url"], F.when(pv["urlKey"].isNotNull() & F.lit(base_url is not None), F.concat(
        F.lit((base_url or "").rstrip("/")), F.lit("/products/"), pv["urlKey"], F.lit("/"), F.lower(pv["sku"]))))
    images = _images(F.coalesce(pv["images"], F.array().cast("array<struct<url:string,label:string,roles:array<string>>>")), True)
    brand = F.element_at(F.filter(F.transform(pv["attributes"], lambda a: F.when(
        (a["name"] == "brand") & (a["value"] != ""), a["value"])), lambda x: x.isNotNull()), -1)
    complex_ = pv["__typename"] == "ComplexProductView"

    def variants_of(parent_images):
        entries = F.flatten(F.transform(pv["options"], lambda o: F.transform(
            F.filter(o["values"], lambda v: v["id"].isNotNull()),
            lambda v: F.struct(v["id"].alias("k"), F.struct(o["id"].alias("oid"), v["title"].alias("t")).alias("v")))))
        # of entries with one UID the last counts
        uid_map = F.map_from_entries(keep_one(entries, lambda e: e["k"], last=True))
        # values used more than once are bound, the map once for a product
        vs = let(let(uid_map, lambda m: F.filter(F.transform(variants, lambda v: one(v, m, parent_images)), lambda x: x.isNotNull())),
                 lambda x: F.when(F.size(x) > 0, x))
        return F.when(complex_ & (F.size(pv["options"]) > 0) & (F.size(variants) > 0), vs)

    def one(v, uid_map, parent_images):
        own = let(_images(F.coalesce(v["product"]["images"], F.array().cast(
            "array<struct<url:string,label:string,roles:array<string>>>")), False),
            lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice(parent_images, 1, 1)))
        picked = F.filter(F.transform(v["selections"], lambda u: F.struct(
            u.alias("uid"), F.element_at(uid_map, u).alias("m"))), lambda x: x["m"].isNotNull())
        # first selection per option id, selection order kept
        opts = keep_one(F.transform(picked, lambda x: F.struct(
            x["m"]["oid"].alias("id"), x["m"]["t"].alias("value"), x["uid"].alias("uid"))), lambda o: o["id"])
        return F.when(v["product"].isNotNull(), F.struct(
            F.coalesce(v["product"]["sku"], F.lit("")).alias("sku"),
            F.coalesce(v["product"]["name"], F.lit("")).alias("name"), F.lit("").alias("url"), own.alias("images"),
            extract_price(v["product"]["price"]).alias("price"),
            _availability(v["product"]["inStock"]).alias("availability"),
            let(opts, lambda x: F.when(F.size(x) > 0, x)).alias("options")))

    def build(imgs):
        return F.struct(
            js_trim(pv["name"]).alias("name"), sku.alias("sku"), url.alias("url"),
            F.when(pv["description"] != "", strip_html(pv["description"])).alias("description"),
            brand.alias("brand"), F.lit(None).cast("string").alias("gtin"),
            F.when(pv["metaTitle"] != "", pv["metaTitle"]).alias("metaTitle"),
            F.when(pv["metaDescription"] != "", pv["metaDescription"]).alias("metaDescription"),
            _availability(pv["inStock"]).alias("availability"), F.lit(None).cast("string").alias("itemCondition"),
            F.when(complex_, extract_price(pv["priceRange"]["minimum"])).otherwise(extract_price(pv["price"]))
            .alias("price"),
            F.when(F.size(pv["images"]) > 0, imgs).alias("images"),
            F.lit(None).cast(RAW_PRODUCT["aggregateRating"].dataType).alias("aggregateRating"),
            variants_of(imgs).alias("variants"),
        ).cast(RAW_PRODUCT)
    return let(images, build)


def source_url(pv: Column, base_url: str | None) -> Column:
    """URL used for the product path."""
    key = F.coalesce(pv["urlKey"], F.lower(pv["sku"]))
    base = (base_url or "https://example.com").rstrip("/")
    return F.concat(F.lit(base + "/products/"), key)


def join_details(listing: DataFrame, details: DataFrame, sku: str = "sku") -> tuple[DataFrame, DataFrame]:
    """Listing left join details; missing -> failed rows."""
    found = listing.join(details, sku, "inner")
    missing = listing.join(details.select(sku), sku, "left_anti") \
        .select(sku, F.lit("failed").alias("status"), F.lit("Product not found").alias("error"))
    return found, missing
