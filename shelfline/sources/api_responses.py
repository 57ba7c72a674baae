"""Scans of stored API responses (one JSON response per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import API_PRODUCT, API_VARIANT

LISTING = T.StructType([T.StructField("data", T.StructType([T.StructField("productSearch", T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("productView", T.StructType([
        T.StructField("sku", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("urlKey", T.StringType()), T.StructField("__typename", T.StringType())]))]))),
    T.StructField("page_info", T.StructType([T.StructField("current_page", T.IntegerType()),
                                             T.StructField("page_size", T.IntegerType()),
                                             T.StructField("total_pages", T.IntegerType())])),
    T.StructField("total_count", T.IntegerType())]))]))])
DETAILS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("data", T.StructType([
    T.StructField("products", T.ArrayType(API_PRODUCT))]))])
VARIANTS = T.StructType([T.StructField("sku", T.StringType()), T.StructField("data", T.StructType([
    T.StructField("variants", T.StructType([T.StructField("variants", T.ArrayType(API_VARIANT))]))]))])


def scan_listing(spark: SparkSession, path: str, max_products: int | None = None) -> DataFrame:
    """Explode search items in (page, position) order, skip NULL
    productViews, optional global cap (first N in listing order)."""
    df = spark.read.schema(LISTING).json(path)
    items = df.select(F.col("data.productSearch.page_info.current_page").alias("page"),
                      F.posexplode("data.productSearch.items").alias("pos", "item"))
    items = items.filter(F.col("item.productView").isNotNull()).select("page", "pos", "item.productView.*")
    return items.orderBy("page", "pos").limit(max_products) if max_products else items


def scan_details(spark: SparkSession, path: str) -> DataFrame:
    """Product views from batched detail responses; the last response
    (by batch, then position) wins for a duplicated SKU."""
    df = spark.read.schema(DETAILS).json(path)
    ex = df.select("batch", F.posexplode("data.products").alias("pos", "p")).filter(F.col("p").isNotNull())
    return ex.groupBy(F.col("p.sku").alias("sku")).agg(F.max_by("p", F.struct("batch", "pos")).alias("pv"))


def scan_variants(spark: SparkSession, path: str) -> DataFrame:
    """(sku, variants) -- missing variant lists become empty arrays."""
    df = spark.read.schema(VARIANTS).json(path)
    return df.select("sku", F.coalesce(F.col("data.variants.variants"),
                                       F.array().cast(T.ArrayType(API_VARIANT))).alias("variants"))
