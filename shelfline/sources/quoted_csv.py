"""S13 for large files: quoted CSV read by many tasks.

A line break ends a record only where the number of quotes before it in the
file is even (doubled quotes do not change that).  So files are read as plain
lines, which Spark splits; every split counts its quotes, the counts are summed
over the splits of a file (one row each), and then every split knows whether it
begins inside a quoted field and finds its record starts by itself.  A record
that runs over the end of its split is put together from the pieces.  Only a
single record must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CSV_COLUMNS


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, rec, record): the records of quoted text files, without
    blank ones; ``split, rec`` order those of a file."""
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value",
        F.regexp_count(value, F.lit('"')).alias("quotes"))
    in_file = Window.partitionBy("file").orderBy("split")
    ahead = Window.unboundedPreceding, -1
    before = lines.groupBy("file", "split").agg(F.sum("quotes").alias("n")) \
        .select("file", "split", F.coalesce(F.sum("n").over(in_file.rowsBetween(*ahead)), F.lit(0)).alias("outside"))
    in_split = Window.partitionBy("file", "split").orderBy("line")
    inside = (F.col("outside") + F.coalesce(F.sum("quotes").over(in_split.rowsBetween(*ahead)), F.lit(0))) % 2 == 1
    starts = lines.join(before, ["file", "split"]).withColumn("start", F.when(inside, 0).otherwise(1))
    # lines before the first start of a split (rec 0) belong to a record of an earlier one
    numbered = starts.withColumn("rec", F.sum("start").over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    pieces = numbered.groupBy("file", "split", "rec").agg(text.alias("text"))
    owner = numbered.groupBy("file", "split").agg(F.max("rec").alias("last")) \
        .select("file", "split", F.last(F.when(F.col("last") > 0, F.struct("split", "last")), True).over(in_file.rowsBetween(*ahead)).alias("own"))
    rest = pieces.filter("rec = 0").join(owner, ["file", "split"]) \
        .groupBy("file", F.col("own.split").alias("split"), F.col("own.last").alias("rec")) \
        .agg(F.array_sort(F.collect_list(F.struct(F.col("split"), "text"))).alias("more"))
    whole = pieces.filter("rec > 0").join(rest, ["file", "split", "rec"], "left")
    record = F.array_join(F.concat(F.array("text"), F.coalesce(F.transform("more", lambda m: m["text"]), F.array().cast("array<string>"))), "\n")
    return whole.select("file", "split", "rec", F.regexp_replace(record, "\r$", "").alias("record")).filter("record <> ''")


def read_quoted_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Header-keyed wide CSV as ``flat.read_csv`` reads it (missing columns and
    fields are '', quoted line breaks kept, blank lines skipped), with
    ``_file`` and ``_row`` in the order of the file.  ``header`` names the
    columns of all files; without it the first line of the files is read."""
    names = header or spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = quoted_records(spark, path).filter((F.col("split") > 0) | (F.col("rec") > 1))
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = rows.select("file", "split", "rec", F.from_csv("record", F.lit(schema), options).alias("r"))
    out = [*CSV_COLUMNS, *[c for c in names if c not in CSV_COLUMNS]]
    return parsed.select(*[(F.coalesce(F.col("r")[c], F.lit("")) if c in names else F.lit("")).alias(c) for c in out],
                         F.col("file").alias("_file"), F.struct("split", "rec").alias("_row"))
