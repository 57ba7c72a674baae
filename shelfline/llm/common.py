"""Helpers shared by the operators: stored intermediate tables, connected
components and streaming of sorted groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: ASCII white space (0x09-0x0D and the blank): the only word separators of the operators.
#: ``bytes.split()`` without arguments splits at exactly these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete the folders of ``stored`` tables whose last reader is done, and
    have Spark look for shuffle files without a reader: it deletes those whose
    plan the driver's collector has found to be free."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            df._stored_at = None
            sc._jvm.System.gc()


def release_memory() -> None:
    """Give memory that is free back to the system, where it can be asked to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` (of record batches) that gives free memory back at its end: a
    worker waits for later stages beside others and keeps what a task freed."""
    @functools.wraps(run)
    def freed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        release_memory()
    return freed


def batches(columns: dict[str, list], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows from equally long lists."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][at:at + rows], f.type) for f in schema],
                                         schema=schema)


#: Bits of a ``key_filter``: 2 MB, whatever the corpus.
BLOOM = 1 << 24


def filter_bits(c) -> list:
    """The two bits of a value in a ``key_filter``."""
    return [F.pmod(F.xxhash64(F.lit(k), c), F.lit(BLOOM)) for k in (1, 2)]


def key_filter(keys: DataFrame, key: str):
    """A function of a column: true for every value that ``keys`` has in ``key``,
    and for few others (a Bloom filter of fixed size, two bits a value; when it
    is full, more values pass).  Its ``has`` is the same of numpy arrays of both
    ``filter_bits``, for tasks that hold the rows anyway."""
    bits = filter_bits
    # at most BLOOM / 64 rows come to the driver
    words = keys.select(F.explode(F.array(*bits(F.col(key)))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    table = np.zeros(BLOOM // 64, np.uint64)
    table[[r["at"] for r in words]] = np.array([r["bits"] for r in words], np.int64).view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def has(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        ok = np.ones(len(one), bool)
        for bit in (one, two):
            ok &= (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok

    @F.pandas_udf("boolean")
    def passes(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(has(one.to_numpy(), two.to_numpy()))

    def test(c):
        return passes(*bits(c))
    test.has = has
    return test


#: Keys that hold more than one in so many rows are broadcast: there are fewer of them than this.
HEAVY = 10_000


def repeated(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` (no nulls) are in ``counts(keys, n)``, with ``n``.

    ``counts`` has the rows of each key in ``rows``, so fewer than ``HEAVY`` keys
    have more than one in ``HEAVY`` rows.  These are broadcast and their rows stay
    where they are; the others are joined by a shuffle without a large key.
    Both tables should be stored: each is read twice or more.
    """
    most = F.lit(rows.count() // HEAVY)
    heavy = F.broadcast(counts.filter(F.col("n") > most))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(counts.filter(F.col("n") <= most), keys)
    return rows.join(heavy, keys).unionByName(light)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` (longs or binaries).

    Returns ``(node, root)`` with the smallest node of each component.  Each
    round points every node at its smallest neighbour (a partial aggregate, so
    a hub costs one row a task), follows the pointers to their ends by doubling
    and contracts the edges to the ends; at least half of the nodes go in a
    round.  The driver only sees two counts a step.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                       .select("node", F.least("node", "m").alias("root")), "points")
        while True:
            nxt = point.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            jumped = stored(point.join(nxt, "root").select("node", F.col("_r").alias("root"),
                                                           (F.col("_r") != F.col("root")).alias("moved")), "points")
            point, moved = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if labels is None:
            labels = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            labels = stored(labels.join(step, "root", "left")
                            .select("node", F.coalesce("_r", "root").alias("root")), "labels")
        ends = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        edges = stored(edges.join(ends("a"), "a").join(ends("b"), "b").filter("_a <> _b")
                       .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    return labels if labels is not None else spark.createDataFrame([], f"node {kind}, root {kind}")


def sorted_groups(batch_iter, key: str) -> Iterator[tuple[object, list[dict]]]:
    """Groups ``(key, rows)`` of a stream of record batches sorted by ``key``."""
    current, rows = None, []
    for batch in batch_iter:
        for row in batch.to_pylist():
            if rows and row[key] != current:
                yield current, rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield current, rows


def arrow_groups(batch_iter, key: int = 0) -> Iterator[pa.Table]:
    """Groups of a stream of record batches sorted by column ``key`` (no nulls),
    as Arrow tables: no row becomes a Python object."""
    held: list[pa.RecordBatch] = []
    for batch in batch_iter:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        if held and held[-1].column(key)[-1] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        change = pa.compute.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False) if len(values) > 1 else np.empty(0, bool)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def by_bytes(batch_iter, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` (strings or binaries) has about ``most`` bytes in each."""
    for batch in batch_iter:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
