"""Incremental ingest of page files with Structured Streaming.

New page files are picked up from a directory; each micro-batch runs the
batch operators and appends to a sink folder keyed by batch id (overwrite of
that key makes a replayed batch idempotent).  ``ingest_crawl`` runs the whole
page path and keeps the URLs seen in hash buckets; ``ingest_pages`` is for row-wise work.  ``dropDuplicates`` on the URL
keeps state so a page already ingested is not processed again; the
checkpoint lives in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def ingest_pages(spark: SparkSession, source_dir: str, schema, process: Callable[[DataFrame], DataFrame],
                 glob: str = "*.parquet", name: str | None = None, max_files: int | None = None,
                 columns: list[str] | None = None) -> str:
    """Run the stream until all present files are processed (availableNow);
    returns the sink folder."""
    base = os.path.join(checkpoint_dir(spark), "ingest", name or uuid.uuid4().hex)
    sink, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source_dir)
    # only what the batch uses goes through the state's shuffle
    deduped = (stream.select(*columns) if columns else stream).dropDuplicates(["url"])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        process(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(os.path.join(sink, f"batch_id={batch_id}"))

    q = (deduped.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def ingest_crawl(spark: SparkSession, source_dir: str, schema, base: str, glob: str = "*.parquet",
                 max_files: int | None = None, key: str = "page_id", **options) -> None:
    """R10 with the whole page path (E, T, V, R1, R2): new page files are crawled
    into ``base/pages`` (``url, status, error, product, ...`` by batch).

    ``base/known`` holds the URLs seen so far (``known.KnownUrls``): a URL in it
    is not crawled again (R1).  Of a URL's copies in one batch the one with the
    smallest ``key`` is taken (null keys last, then by file and row); a null URL
    is a URL of its own.  Only URL, key and row number are compared and
    shuffled; pages are picked by row number.  A second call with the same
    ``base`` resumes after the last finished batch; a replayed batch sees the
    URLs of earlier batches only and overwrites its own rows.
    """
    from ..plans.page_crawl import crawl_pages
    from .known import KnownUrls
    sink, ckpt = os.path.join(base, "pages"), os.path.join(base, "checkpoint")
    checkpoint_dir(spark)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        known = KnownUrls(batch.sparkSession, os.path.join(base, "known"))
        first = batch.groupBy("url").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), "_place")).alias("_first")) \
            .select("url", "_first._place")
        fresh = known.unseen(first, batch_id).checkpoint()
        pages = batch.join(fresh.select("_place"), "_place", "left_semi").drop("_place")
        crawl_pages(pages, **options).write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))
        known.add(fresh.select("url"), batch_id)

    q = (reader.parquet(source_dir).withColumn("_place", place).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
