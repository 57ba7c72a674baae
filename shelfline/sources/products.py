"""S10 product-file scan and S11 path-addressed product sink, plain and versioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PRODUCT

VERSION_BUCKETS = 64


def write_products(products: DataFrame, path: str, ordinal_col: str | None = None) -> None:
    """One record per product path (a later write of the same path wins:
    ``max_by`` on the ordinal), JSON lines partitioned by the first path
    segment -- many records per file, never one file per product."""
    cols = [f.name for f in PRODUCT.fields]
    if ordinal_col:
        last = products.groupBy("path").agg(F.max_by(F.struct(*cols), F.col(ordinal_col)).alias("p")).select("p.*")
    else:
        last = products.select(*cols)
    seg = F.split_part(F.col("path"), F.lit("/"), F.lit(2))
    last.withColumn("segment", F.when(seg != "", seg)).write.mode("overwrite").partitionBy("segment") \
        .option("ignoreNullFields", True).json(path)


def scan_products(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Recursive scan of product JSON files: ``product``, the record as read
    (``raw``, VARIANT, so that wrong types can be told) and ``file``; an
    unreadable record has a ``parse_error`` instead of failing the job.

    ``one_per_file``: each file is one (pretty-printed) product; otherwise each
    line is one, and files can be split.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json") \
        .text(path, wholetext=one_per_file).select("value", F.col("_metadata.file_path").alias("file"))
    df = df.filter(F.col("value").rlike("\\S"))
    raw = F.try_parse_json("value")
    return df.select(F.from_json("value", PRODUCT).alias("product"), raw.alias("raw"), "file",
                     F.when(raw.isNull(), F.lit("Unexpected token in JSON")).alias("parse_error"))


def write_version(products: DataFrame, path: str, version: int, ordinal_col: str | None = None, buckets: int = VERSION_BUCKETS) -> None:
    """S11 over several crawls: the records of one crawl, one for each product
    path, in buckets of the path's hash below ``path/version=``.

    Only this version's folder is written, so a later crawl replaces the paths
    it has and leaves all others alone; a repeated write replaces itself.  Of a
    path's records the one with the largest ordinal counts, of equal ordinals
    the one that is largest as JSON, so reruns agree.
    """
    cols = [f.name for f in PRODUCT.fields]
    record = F.struct(*cols)
    rank = F.struct(F.col(ordinal_col) if ordinal_col else F.lit(0), F.to_json(record))
    last = products.groupBy("path").agg(F.max_by(record, rank).alias("p")).select("p.*")
    last.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).repartition("bucket") \
        .write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", True).json(f"{path.rstrip('/')}/version={version}")


def read_versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The products after all crawls (or those up to version ``upto``): of each
    path the record of its last version, with that ``version``."""
    schema = T.StructType([*PRODUCT.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(schema).json(path)
    if upto is not None:
        rows = rows.filter(F.col("version") <= upto)
    cols = [f.name for f in PRODUCT.fields]
    return rows.groupBy("path").agg(F.max_by(F.struct(*cols, "version"), "version").alias("p")).select("p.*")
