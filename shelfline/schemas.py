"""Declared schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()


def _st(*names: str, **typed) -> T.StructType:
    fields = [T.StructField(n, S) for n in names]
    fields += [T.StructField(k, v) for k, v in typed.items()]
    return T.StructType(fields)


# M2 / M3 / M5 / M7
PRICE = _st("currency", "regular", "final")
IMAGE = T.StructType([T.StructField("url", S), T.StructField("label", S),
                      T.StructField("roles", T.ArrayType(S))])
OPTION = _st("id", "value", "uid")
RATING = _st("ratingValue", "reviewCount", "bestRating", "worstRating")

# M4 variant (raw and transformed share the shape)
VARIANT = T.StructType([
    T.StructField("sku", S), T.StructField("name", S), T.StructField("url", S),
    T.StructField("images", T.ArrayType(IMAGE)), T.StructField("price", PRICE),
    T.StructField("availability", S), T.StructField("options", T.ArrayType(OPTION)),
])

# M10 raw product (extractor / normalizer output)
RAW_PRODUCT = T.StructType([
    T.StructField("name", S), T.StructField("sku", S), T.StructField("url", S),
    T.StructField("description", S), T.StructField("brand", S), T.StructField("gtin", S),
    T.StructField("metaTitle", S), T.StructField("metaDescription", S),
    T.StructField("availability", S), T.StructField("itemCondition", S),
    T.StructField("price", PRICE), T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("aggregateRating", RATING), T.StructField("variants", T.ArrayType(VARIANT)),
])

# M6 top-level option
OPTION_VALUE = _st("value", "uid")
TOP_OPTION = T.StructType([
    T.StructField("id", S), T.StructField("label", S), T.StructField("position", T.IntegerType()),
    T.StructField("values", T.ArrayType(OPTION_VALUE)),
])

# M9 custom
CUSTOM = T.StructType([T.StructField("categories", T.ArrayType(S)),
                       T.StructField("related", T.ArrayType(S))])

# M1 product (output contract)
PRODUCT = T.StructType([
    T.StructField("path", S), T.StructField("sku", S), T.StructField("name", S),
    T.StructField("url", S), T.StructField("description", S), T.StructField("metaTitle", S),
    T.StructField("metaDescription", S), T.StructField("brand", S), T.StructField("gtin", S),
    T.StructField("price", PRICE), T.StructField("availability", S),
    T.StructField("itemCondition", S), T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("aggregateRating", RATING), T.StructField("variants", T.ArrayType(VARIANT)),
    T.StructField("options", T.ArrayType(TOP_OPTION)),
    T.StructField("metadata", T.MapType(S, S)), T.StructField("custom", CUSTOM),
])

# M15 wide CSV row: 13 fixed + 10 images + 10 roles + 6 tail columns; data with
# more images to a product have more image columns
NUM_IMAGE_COLS = 10


def csv_columns(images: int = NUM_IMAGE_COLS) -> list[str]:
    return (["type", "sku", "parent_sku", "name", "path", "url", "description", "meta_title",
             "meta_description", "price_currency", "price_regular", "price_final", "availability"]
            + [f"image_{i}" for i in range(1, images + 1)] + [f"image_{i}_roles" for i in range(1, images + 1)]
            + ["option_size", "option_color", "option_size_uid", "option_color_uid", "categories", "related"])


CSV_COLUMNS = csv_columns()
CSV_ROW = T.StructType([T.StructField(c, S) for c in CSV_COLUMNS])

# M14 crawl state
CRAWL_STATE = T.StructType([
    T.StructField("url", S), T.StructField("status", S), T.StructField("error", S),
    T.StructField("crawled_at", T.TimestampType()), T.StructField("ordinal", T.LongType()),
])

# A2 / A3 API product view and variants
_AMOUNT = T.StructType([T.StructField("value", T.DecimalType(18, 2)), T.StructField("currency", S)])
_MONEY = T.StructType([T.StructField("amount", _AMOUNT)])
API_PRICE = T.StructType([T.StructField("final", _MONEY), T.StructField("regular", _MONEY)])
API_IMAGE = T.StructType([T.StructField("url", S), T.StructField("label", S),
                          T.StructField("roles", T.ArrayType(S))])
API_ATTRIBUTE = T.StructType([T.StructField("name", S), T.StructField("label", S),
                              T.StructField("value", S), T.StructField("roles", T.ArrayType(S))])
API_OPTION_VALUE = T.StructType([T.StructField("id", S), T.StructField("title", S),
                                 T.StructField("inStock", T.BooleanType())])
API_OPTION = T.StructType([T.StructField("id", S), T.StructField("title", S),
                           T.StructField("values", T.ArrayType(API_OPTION_VALUE))])
API_PRODUCT = T.StructType([
    T.StructField("__typename", S), T.StructField("sku", S), T.StructField("name", S),
    T.StructField("urlKey", S), T.StructField("url", S), T.StructField("description", S),
    T.StructField("metaTitle", S), T.StructField("metaDescription", S),
    T.StructField("inStock", T.BooleanType()), T.StructField("images", T.ArrayType(API_IMAGE)),
    T.StructField("attributes", T.ArrayType(API_ATTRIBUTE)), T.StructField("price", API_PRICE),
    T.StructField("priceRange", T.StructType([T.StructField("minimum", API_PRICE),
                                              T.StructField("maximum", API_PRICE)])),
    T.StructField("options", T.ArrayType(API_OPTION)),
])
API_VARIANT = T.StructType([
    T.StructField("selections", T.ArrayType(S)),
    T.StructField("product", T.StructType([
        T.StructField("sku", S), T.StructField("name", S), T.StructField("inStock", T.BooleanType()),
        T.StructField("images", T.ArrayType(API_IMAGE)), T.StructField("price", API_PRICE)])),
])
