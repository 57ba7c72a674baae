"""The URLs that earlier batches have seen, in buckets of the URL's hash.

Every batch adds one file to each bucket its new URLs fall into, and a Bloom
filter of them.  A later batch asks the filters of its own buckets (about two
bytes a URL); only URLs that a filter lets through are compared with the stored
URLs, and only their buckets are opened: the read has a partition filter on
``bucket``.  So a batch of new URLs opens few buckets, and a batch of one site's
known URLs as many as it has URLs at most, however many are known.

Layout below ``base``: ``urls/batch_id=/bucket=`` and ``filters/batch_id=/bucket=``.
A repeated batch overwrites its own folders and looks at earlier batches only,
so it gives the same rows.  A null URL is a URL like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BUCKETS = 256
BITS, PROBES = 16, 8  # a filter lets 1 of 1,700 unknown URLs through


def _hashes(url: str) -> list[Column]:
    return [F.xxhash64(F.lit("a"), url).alias("_h1"), F.xxhash64(F.lit("b"), url).alias("_h2")]


def probes(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers (keys x PROBES) in a filter of ``bits`` bits."""
    step = h2.view(np.uint64) | np.uint64(1)
    return (h1.view(np.uint64)[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _filter(table: pa.Table) -> pa.Table:
    bits = 8 * -(-table.num_rows * BITS // 8)
    marks = np.zeros(bits, bool)
    marks[probes(_longs(table, "_h1"), _longs(table, "_h2"), bits).ravel()] = True
    return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(marks).tobytes()])})


def _let_through(urls: pa.Table, filters: pa.Table) -> pa.Table:
    hit = np.zeros(urls.num_rows, bool)
    h1, h2 = _longs(urls, "_h1"), _longs(urls, "_h2")
    for packed in filters.column("bits").to_pylist():
        marks = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        hit |= marks[probes(h1, h2, len(marks))].all(1)
    return urls.filter(pa.array(hit)).select(["url", "bucket"])


class KnownUrls:
    """State of the URLs seen so far below the shared folder ``base``."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, urls: DataFrame, batch_id: int) -> None:
        """Store ``urls(url)``, distinct and unseen, as those of ``batch_id``."""
        at = f"{self.base}/urls/batch_id={batch_id}"
        urls.select("url", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        stored = self.spark.read.schema("url string, bucket int").parquet(at)
        stored.select("bucket", *_hashes("url")).groupBy("bucket").applyInArrow(_filter, "bucket int, bits binary") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/filters/batch_id={batch_id}")

    def _read(self, what: str, column: str, before: int) -> DataFrame:
        table = self.spark.read.schema(f"{column}, bucket int, batch_id long").parquet(f"{self.base}/{what}")
        return table.filter(F.col("batch_id") < before)

    def opened(self, buckets: list[int], before: int) -> DataFrame:
        """The URLs of ``buckets`` that batches before ``before`` have stored."""
        return self._read("urls", "url string", before).filter(F.col("bucket").isin(buckets)).select("url")

    def unseen(self, urls: DataFrame, before: int) -> DataFrame:
        """The rows of ``urls`` (with a column ``url``) whose URL no batch before ``before`` has."""
        if before <= 0:
            return urls
        checkpoint_dir(self.spark)
        asked = urls.select("url", self._bucket(), *_hashes("url")).distinct()
        maybe = asked.groupBy("bucket").cogroup(self._read("filters", "bits binary", before).groupBy("bucket")) \
            .applyInArrow(lambda a, b: _let_through(a, b), "url string, bucket int").checkpoint()
        touched = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        seen = self.opened(touched, before).select(F.col("url").alias("_url"))
        again = maybe.join(seen, F.col("url").eqNullSafe(F.col("_url")), "left_semi").select(F.col("url").alias("_again"))
        return urls.join(again, F.col("url").eqNullSafe(F.col("_again")), "left_anti")
