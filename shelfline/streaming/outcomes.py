"""R2 as a stream: crawl outcomes that arrive out of order.

Every URL has a small state: what was seen last by sequence number, of its
status, its crawl time and its error, and the number of its discovery.
Batches may come in any order and twice: an older outcome changes nothing, so
the last rows equal ``state.apply_outcomes`` over the whole log.  Outcomes of a
URL that is not discovered yet are kept in its state and shown once it is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LOG = ["seq1", "seq2", "status", "error", "at", "ordinal"]
_OUT = "url string, status string, error string, crawled_at long, ordinal long"
#: The sequence number (two longs) of each part of the state, and its value.
_STATE = ("found1 long, found2 long, ordinal long, last1 long, last2 long, status string, "
          "crawled1 long, crawled2 long, crawled_at long, bad1 long, bad2 long, error string")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else [None] * 12

    def keep(at: int, seq: tuple[int, int], value, least: bool = False) -> None:
        old = (held[at], held[at + 1])
        if old[0] is None or (seq < old if least else seq > old):
            held[at], held[at + 1], held[at + 2] = *seq, value
    for frame in frames:
        for seq1, seq2, status, error, at, ordinal in zip(*(frame[c].tolist() for c in _LOG)):
            seq = (int(seq1), int(seq2))
            if status == "discovered":
                keep(0, seq, int(ordinal), least=True)
                continue
            keep(3, seq, status)
            if status == "crawled":
                keep(6, seq, None if pd.isna(at) else int(at))
            else:
                keep(9, seq, None if error is None or error != error else error)
    state.update(tuple(held))
    if held[0] is not None:
        # typed as they are made: casting a frame costs more than the rest of a key's work
        yield pd.DataFrame({"url": [key[0]], "status": [held[5] or "pending"], "error": [held[11]],
                            "crawled_at": pd.array([held[8]], "Int64"), "ordinal": pd.array([held[2]], "Int64")})


def stream_outcomes(spark: SparkSession, source_dir: str, base: str, max_files: int | None = None) -> None:
    """Run the log files ``(url, seq1, seq2, status, error, at, ordinal)`` of
    ``source_dir`` (Parquet; ``at`` in microseconds, ``status`` discovered,
    crawled, failed or skipped) through the state.  Changed URLs go to
    ``base/rows`` by batch; a second call resumes after the last batch."""
    checkpoint_dir(spark)
    reader = spark.readStream.schema("url string, seq1 long, seq2 long, status string, error string, at long, ordinal long")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(source_dir).groupBy("url").applyInPandasWithState(_advance, _OUT, _STATE, "update", "NoTimeout")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(base, "rows", f"batch_id={batch_id}"))
    rows.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", os.path.join(base, "checkpoint")) \
        .trigger(availableNow=True).start().awaitTermination()


def current_state(spark: SparkSession, base: str) -> DataFrame:
    """The state table (url, status, error, crawled_at, ordinal): each URL's row of the last batch that changed it."""
    rows = spark.read.schema(_OUT + ", batch_id long").parquet(os.path.join(base, "rows"))
    last = rows.groupBy("url").agg(F.max_by(F.struct("status", "error", "crawled_at", "ordinal"), "batch_id").alias("s"))
    return last.select("url", "s.status", "s.error", F.timestamp_micros("s.crawled_at").alias("crawled_at"), "s.ordinal")
