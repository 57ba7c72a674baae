"""Raw product -> target product schema, with warnings and errors.

``transform_product`` is one Catalyst expression over the raw-product struct
and the source URL: it runs inside the row, so the whole page -> product path
stays a single narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import normalize_availability, normalize_condition
from ..functions.text import JS_WS, js_trim, keep_one, let, once, word_capitalize
from ..functions.urls import product_path, sanitize_sku, sku_from_url
from ..schemas import IMAGE, PRODUCT, TOP_OPTION, VARIANT
from .validate import validate_product

_ARR_IMAGE = f"array<{IMAGE.simpleString()}>"



def _truthy_str(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def variant_sku_suffix(parent_sku: Column, ordinal: Column) -> Column:
    """Deterministic stand-in for the reference's random 5-character suffix."""
    return F.substring(F.sha2(F.concat_ws("#", parent_sku, ordinal.cast("string")), 256), 1, 5)


def transform_variant(v: Column, i: Column, parent: Column, source_url: Column) -> Column:
    """One raw variant -> product variant, or NULL (dropped)."""
    sku = let(sanitize_sku(v["sku"]), lambda x: F.when(x != "", x).otherwise(
        F.concat(parent["sku"], F.lit("-"), variant_sku_suffix(parent["sku"], i))))
    own = F.transform(F.filter(F.coalesce(v["images"], F.array().cast(_ARR_IMAGE)),
                               lambda im: _truthy_str(im["url"])),
                      lambda im: F.struct(im["url"].alias("url"),
                                          F.when(_truthy_str(im["label"]), im["label"]).alias("label"),
                                          F.lit(None).cast("array<string>").alias("roles")))
    parent_first = F.slice(F.coalesce(parent["images"], F.array().cast(_ARR_IMAGE)), 1, 1)
    images = let(own, lambda ims: F.when(F.size(ims) > 0, ims).otherwise(parent_first))
    vp = v["price"]
    price = F.when(vp.isNotNull(), F.struct(
        F.when(_truthy_str(vp["currency"]), F.upper(vp["currency"]))
        .when(_truthy_str(parent["price"]["currency"]), parent["price"]["currency"]).alias("currency"),
        vp["regular"].alias("regular"), vp["final"].alias("final")))
    options = F.when(F.size(v["options"]) > 0, F.transform(v["options"], lambda o: F.struct(
        F.when(_truthy_str(o["id"]), o["id"]).alias("id"),
        F.coalesce(o["value"], F.lit("undefined")).alias("value"),
        F.when(_truthy_str(o["uid"]), o["uid"]).alias("uid"))))
    out = F.struct(
        sku.alias("sku"),
        F.when(_truthy_str(v["name"]), v["name"]).otherwise(parent["name"]).alias("name"),
        F.when(_truthy_str(v["url"]), v["url"]).otherwise(source_url).alias("url"),
        images.alias("images"), price.alias("price"),
        F.when(_truthy_str(v["availability"]), normalize_availability(v["availability"])).alias("availability"),
        options.alias("options"),
    )
    return let(out, lambda o: F.when(v.isNotNull() & (F.size(o["images"]) > 0), o))


def top_level_options(variants: Column) -> Column:
    """Options grouped by id (or value slug) in first-encounter order,
    distinct values first-seen, first UID wins, labels word-capitalised."""
    flat = F.filter(F.flatten(F.transform(variants, lambda v: F.coalesce(
        v["options"], F.array().cast("array<struct<id:string,value:string,uid:string>>")))),
        lambda o: _truthy_str(o["value"]))
    keyed = F.transform(flat, lambda o: F.struct(
        F.when(_truthy_str(o["id"]), o["id"])
        .otherwise(F.regexp_replace(F.lower(o["value"]), f"{JS_WS}+", "-")).alias("id"),
        F.when(_truthy_str(o["id"]), o["id"]).otherwise(o["value"]).alias("label_src"),
        o["value"].alias("value"), o["uid"].alias("uid")))

    def options(first):  # the first element of every id and value, in order
        def build(oid, i):
            def option(mine):
                label = word_capitalize(F.regexp_replace(F.get(mine, 0)["label_src"], "[-_]", " "))
                return F.struct(oid.alias("id"), label.alias("label"), (i + 1).alias("position"), F.transform(mine, lambda o: F.struct(
                    o["value"].alias("value"), F.when(_truthy_str(o["uid"]), o["uid"]).alias("uid"))).alias("values"))
            return let(F.filter(first, lambda o: o["id"] == oid), option)
        return F.transform(F.array_distinct(F.transform(first, lambda o: o["id"])), build)

    opts = let(keep_one(keyed, lambda o: (o["id"], o["value"])), options)
    return let(opts, lambda o: F.when(F.size(o) > 0, o)).cast(f"array<{TOP_OPTION.simpleString()}>")


def transform_product(raw: Column, source_url: Column, prefix: str | None = None,
                      default_currency: str = "USD") -> Column:
    """T1-T12 + V1 -> struct(product, warnings, errors); product NULL on error."""
    sku0 = sanitize_sku(raw["sku"])
    core = F.struct(product_path(source_url, prefix).alias("path"),
                    F.when(sku0 != "", sku0).otherwise(sku_from_url(source_url)).alias("sku"),
                    js_trim(raw["name"]).alias("name"))
    rp = raw["price"]
    currency = F.when(_truthy_str(rp["currency"]), F.upper(rp["currency"])).otherwise(F.lit(default_currency))
    price = F.when(rp.isNotNull(), F.struct(currency.alias("currency"), rp["regular"].alias("regular"),
                                            rp["final"].alias("final")))
    images = F.transform(F.filter(F.coalesce(raw["images"], F.array().cast(_ARR_IMAGE)),
                                  lambda im: _truthy_str(im["url"]) & im["url"].startswith("http")),
                         lambda im: F.struct(im["url"].alias("url"),
                                             F.when(_truthy_str(im["label"]), im["label"]).alias("label"),
                                             im["roles"].alias("roles")))
    r = raw["aggregateRating"]
    rating = F.when(r.isNotNull() & (r["ratingValue"].isNotNull() | r["reviewCount"].isNotNull()
                                     | r["bestRating"].isNotNull() | r["worstRating"].isNotNull()), r)
    availability = F.when(_truthy_str(raw["availability"]), normalize_availability(raw["availability"]))

    def with_core(c):
        parent0 = F.struct(c["sku"].alias("sku"), c["name"].alias("name"),
                           let(images, lambda im: F.when(F.size(im) > 0, im)).alias("images"),
                           price.alias("price"))
        return let(parent0, lambda parent: with_parent(c, parent))

    def with_parent(c, parent):
        variants = F.filter(F.transform(raw["variants"], lambda v, i: transform_variant(v, i, parent, source_url)),
                            lambda v: v.isNotNull())
        return let(let(variants, lambda x: F.when(F.size(x) > 0, x)), lambda vs: with_variants(c, parent, vs))

    def with_variants(c, parent, vs):
        product = F.struct(
            c["path"].alias("path"), c["sku"].alias("sku"), c["name"].alias("name"),
            F.when(_truthy_str(raw["url"]), raw["url"]).otherwise(source_url).alias("url"),
            F.when(_truthy_str(raw["description"]), raw["description"]).alias("description"),
            F.when(_truthy_str(raw["metaTitle"]), raw["metaTitle"]).alias("metaTitle"),
            F.when(_truthy_str(raw["metaDescription"]), raw["metaDescription"]).alias("metaDescription"),
            F.when(_truthy_str(raw["brand"]), js_trim(raw["brand"])).alias("brand"),
            F.when(_truthy_str(raw["gtin"]), raw["gtin"]).alias("gtin"),
            parent["price"].alias("price"), availability.alias("availability"),
            F.when(_truthy_str(raw["itemCondition"]), normalize_condition(raw["itemCondition"])).alias("itemCondition"),
            parent["images"].alias("images"), rating.alias("aggregateRating"),
            vs.cast(f"array<{VARIANT.simpleString()}>").alias("variants"),
            top_level_options(vs).alias("options"),
            F.lit(None).cast("map<string,string>").alias("metadata"),
            F.lit(None).cast(PRODUCT["custom"].dataType).alias("custom"),
        ).cast(PRODUCT)
        return let(product, lambda prod: finish(c, prod))

    def finish(c, prod):
        sku_warn = F.when(c["sku"] == "", F.lit("No SKU found, derived from URL"))
        warnings = F.filter(F.array(
            sku_warn,
            F.when(rp.isNotNull() & ~_truthy_str(rp["currency"]),
                   F.lit(f"No currency found, defaulting to {default_currency}")),
            F.when(_truthy_str(raw["availability"]) & availability.isNull(),
                   F.format_string('Unknown availability value: "%s"', raw["availability"])),
        ), lambda x: x.isNotNull())
        errors = (F.when(raw.isNull(), F.array(F.lit("No data to transform")))
                  .when(c["path"].isNull(), F.array(F.format_string(
                      "Could not generate valid path from URL: %s", source_url)))
                  .when(~_truthy_str(c["name"]), F.array(F.lit("No product name found")))
                  .otherwise(validate_product(prod)))
        warns = (F.when(raw.isNull() | c["path"].isNull(), F.array().cast("array<string>"))
                 .when(~_truthy_str(c["name"]), F.filter(F.array(sku_warn), lambda x: x.isNotNull()))
                 .otherwise(warnings))
        return let(errors, lambda errs: F.struct(F.when(F.size(errs) == 0, prod).alias("product"),
                                                 warns.alias("warnings"), errs.alias("errors")))
    return let(core, with_core)


def transform_frame(df: DataFrame, raw_col: str = "raw", url_col: str = "url", prefix: str | None = None,
                    default_currency: str = "USD") -> DataFrame:
    """Apply T* + V1 to a frame; adds ``product``, ``warnings``, ``errors``."""
    t = transform_product(F.col(raw_col), F.col(url_col), prefix, default_currency)
    return df.select("*", once(t).alias("_t")).select("*", "_t.product", "_t.warnings", "_t.errors").drop("_t")
