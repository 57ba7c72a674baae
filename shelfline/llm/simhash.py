"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: the majority of XXH64 bits over word shingles.  Two distinct
fingerprints within ``max_bits`` differing bits are linked.  The fingerprint
is cut into ``SEGMENTS`` equal segments on a ring.  By the pigeonring
principle a pair within ``max_bits`` has a start segment from which *every*
chain of 1, 2, ... consecutive segments differs in at most ``length *
max_bits / SEGMENTS`` bits.  With the budget below one bit a segment, the
first segment of such a chain is equal, so fingerprints meet in buckets of
(start, segment value); inside a bucket the chain test prunes candidates
before the full Hamming check.

Defined results: null text has no word (fingerprint 0); null ``doc_id`` rows
keep their fingerprint and component, but never name a component (a
component of null ids only has a null id); repeated rows are returned as often as
they come; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, batches, components, lean, stored

SEGMENTS = 4
SEED = 42
#: Rows of a bucket that one task compares; larger buckets are split by the next segment.
BUCKET_ROWS = 50_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of ``text``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        raw = digest(b" ".join(words), SEED)
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1:] - 1).tolist()
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    seen = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(seen), 1 << 16):
        counts += np.bincount((seen[at:at + (1 << 16)] + _BYTE_AT).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(seen)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as signed long; texts are read once and never shuffled."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(t, shingle) for t in (x.as_py() for x in batch.column(1))),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(lean(run), f"doc_id {kind}, fp bigint")


def _segments(fps: np.ndarray) -> np.ndarray:
    width = 64 // SEGMENTS
    shifts = np.uint64(64) - np.uint64(width) * np.arange(1, SEGMENTS + 1, dtype=np.uint64)
    return (fps[:, None] >> shifts[None, :]) & np.uint64((1 << width) - 1)


def ring_links(fps: np.ndarray, start: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints equal in segment ``start`` whose
    chains from it stay within budget and that differ in ``max_bits`` bits at
    most.  Candidates are looked up by the second segment of the chain (equal
    or one bit off when its budget allows one), never by all pairs."""
    seg = _segments(fps)
    second = seg[:, (start + 1) % SEGMENTS].astype(np.int64)
    order = np.argsort(second, kind="stable")
    values = second[order]
    allowed = 2 * max_bits // SEGMENTS  # bits of the chain of two; the first segment has none
    width = 64 // SEGMENTS
    flips = [0, *(1 << b for b in range(width))] if allowed >= 1 else [0]
    out_a, out_b = [], []
    for flip in flips:
        lo = np.searchsorted(values, second ^ flip, "left")
        hi = np.searchsorted(values, second ^ flip, "right")
        todo = np.flatnonzero(hi > lo)
        at = 0
        while at < len(todo):  # blocks of about a million candidates
            sizes = np.cumsum(hi[todo[at:]] - lo[todo[at:]])
            upto = at + max(1, int(np.searchsorted(sizes, 1_000_000)))
            block = todo[at:upto]
            reps = hi[block] - lo[block]
            a = np.repeat(block, reps)
            b = order[np.repeat(lo[block], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
            keep = a < b
            a, b = a[keep], b[keep]
            spent = np.zeros(len(a), np.int64)
            for length in range(2, SEGMENTS + 1):
                s = (start + length - 1) % SEGMENTS
                spent += np.bitwise_count(seg[a, s] ^ seg[b, s])
                ok = spent <= length * max_bits // SEGMENTS
                a, b, spent = a[ok], b[ok], spent[ok]
            ok = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            out_a.append(a[ok])
            out_b.append(b[ok])
            at = upto
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, int), np.empty(0, int))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the links: as few edges as keep their components."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = top(x), top(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that keep every
    component of the links (a spanning forest for each bucket, so a bucket of
    n fingerprints gives fewer than n rows)."""
    if max_bits >= SEGMENTS:
        raise ValueError(f"max_bits must be below {SEGMENTS}")
    width = 64 // SEGMENTS
    seg = lambda s: F.shiftrightunsigned("fp", 64 - width * (s % SEGMENTS + 1)).bitwiseAND((1 << width) - 1)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), seg(s).alias("value"),
                                                         seg(s + 1).alias("next")) for s in range(SEGMENTS)])).alias("x")) \
        .select("fp", "x.*")
    sizes = rows.groupBy("start", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows)
    rows = rows.join(sizes, ["start", "value"], "left")
    # a large bucket: one smaller bucket for each next segment equal or one bit off
    split = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.array(F.col("next") + 0, *[F.col("next").bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b)).cast("long"))
                                     + F.lit((b + 1) << width) for b in range(width)]))
    rows = rows.select("fp", "start", F.explode(split).alias("part"), "value") \
        .withColumn("bucket", F.xxhash64("start", "value", "part")) \
        .select("fp", "start", "value", "part", "bucket")
    # comparing takes longer than moving: as many tasks as the session has for a shuffle, not fewer for few bytes
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "start", "value", "part") \
        .select(F.concat_ws("/", "start", "value", "part").alias("key"), "fp", "start")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in arrow_groups(it):
            if group.num_rows < 2:
                continue
            own = np.unique(group.column("fp").to_numpy()).view(np.uint64)
            x, y = _forest(len(own), *ring_links(own, group.column("start")[0].as_py(), max_bits))
            signed = own.view(np.int64)
            a += signed[x].tolist()
            b += signed[y].tolist()
            if len(a) > 50_000:
                yield from batches({"a": a, "b": b}, _EDGES)
                a, b = [], []
        yield from batches({"a": a, "b": b}, _EDGES)
    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (smallest ``doc_id`` reachable over links)."""
    spark = docs.sparkSession
    each = stored(fingerprints(docs, shingle, id_col, text_col), "fp")
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(spark, links(nodes.select("fp"), max_bits, bucket_rows))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(named, "root").select("fp", "component_id")
    return each.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                      "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id
    (nulls last), of equal ids the first row stored.  Rows are told apart by
    their number in a stored copy, not by id: different texts under one id all
    stay, and near copies without an id go."""
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    name = f"doc.`{id_col}`"
    comp = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text")), shingle, max_bits)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")
    kept = rows.select("row", F.col(name).alias("id")).join(comp.withColumnRenamed("doc_id", "row"), "row") \
        .groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
