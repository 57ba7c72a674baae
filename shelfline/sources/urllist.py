"""URL list files -- one URL per line; blank lines and '#' comments skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, file, line) rows; ``line`` orders URLs inside one file."""
    df = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"),
                                      F.monotonically_increasing_id().alias("line"))
    url = F.regexp_replace("value", r"^[\s ﻿]+|[\s ﻿]+$", "")
    return df.select(url.alias("url"), "file", "line").filter((F.col("url") != "") & ~F.col("url").startswith("#"))
