"""Removal of long repeats with a sparse enhanced suffix array.

A repeat is a byte string of ``min_len`` bytes that starts at two places or
more, in one document or in several.  A suffix array over every byte would
move many times the corpus, so only *anchors* enter it: of each window of
``min_len`` bytes the first position whose ``anchor_bytes``-gram has the
smallest hash.  The choice depends on the window's bytes alone, so all places
of a repeat have the same anchor at the same offset.  Every anchor knows the
windows that chose it; their union is its *context*, split at the anchor into
a left and a right part.

1. anchors of each distinct text (numpy, one pass, no shuffle of texts);
2. anchors whose gram hash occurs once in the corpus go;
3. the contexts of the rest are shuffled by gram hash; the suffixes (right
   parts) of a group are sorted, the common prefix lengths of neighbours are
   stack-scanned into the tree of common-prefix intervals, and in each
   interval the occurrences are ordered by their left extension.  An interval
   whose occurrences extend to the left differently is a maximal repeat group
   with *all* its occurrences (``repeat_groups``); for each occurrence the
   widest repeat on either side is kept (``repeat_spans``);
4. groups above ``group_rows`` distinct contexts do not go through one task:
   their windows are counted one by one by hash, which gives the same spans.

Defined results: null text is empty; texts below ``min_len`` bytes never lose
a byte; equal texts and repeated rows are repeats of each other; null ids are
kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_bytes, filter_bits, key_filter, lean, release, repeated, sorted_groups, stored

MIN_LEN = 400
#: Distinct contexts of one gram that one task holds (below 700 bytes each).
GROUP_ROWS = 20_000
#: Texts that a task remembers to cut equal ones once; later readers drop what is cut twice.
SEEN = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n``."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
        have = _powers[int(base)] = (grow(base), grow(inv))
    return have


def gram_hashes(data: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Mixed 64-bit polynomial hashes of all substrings of ``size`` bytes."""
    power, inverse = _power_tables(len(data), base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    n = len(data) - size + 1
    h = (sums[size:] - sums[:-size]) * inverse[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, min_len: int, gram: int):
    """Anchor positions, first and last window start that chose each, gram hashes."""
    hashes = gram_hashes(data, gram)
    span = min_len - gram + 1  # grams in a window
    # the upper half orders, the lower half is the position: ties go to the first
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], first, last, hashes[at[first]].view(np.int64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def interval_scan(left: list[bytes], right: list[bytes], min_len: int, group=None) -> list[tuple[int, int]]:
    """Widest repeat around each occurrence as (bytes left, bytes right); (0, 0): none.

    ``left`` holds the reversed left parts, ``right`` the suffixes.  The scan
    walks the sorted suffixes, keeps the open intervals on a stack and joins
    a closing interval into its parent, smaller set into larger.  At each join
    an occurrence is compared with its neighbours in the order of the left
    extensions, which are its longest common extensions inside the interval.
    ``group(length, left_bytes, occurrences)`` is called for each maximal
    repeat: an interval, cut where the left extensions share too little, whose
    occurrences differ in the byte before the shared left extension.
    """
    n = len(right)
    suffixes = sorted(range(n), key=right.__getitem__)
    by_left = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for r, x in enumerate(by_left):
        rank[x] = r
    reach = [(0, 0)] * n

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        for r in small:
            at = bisect_left(large, r)
            x = by_left[r]
            for other in large[max(0, at - 1):at + 1]:
                y = by_left[other]
                ext = _common(left[x], left[y])
                if ext + depth >= min_len:
                    reach[x] = (max(reach[x][0], ext), max(reach[x][1], depth))
                    reach[y] = (max(reach[y][0], ext), max(reach[y][1], depth))
            large.insert(at, r)
        return large

    def report(members: list[int], depth: int) -> None:
        chain = [members[0]]
        ext = None
        for r in [*members[1:], None]:
            share = -1 if r is None else _common(left[by_left[chain[-1]]], left[by_left[r]])
            if share + depth >= min_len:
                ext = share if ext is None else min(ext, share)
                chain.append(r)
                continue
            if ext is not None:
                before = {left[by_left[c]][ext:ext + 1] for c in chain}
                if len(before) > 1 or b"" in before:  # extends to the left differently
                    group(ext + depth, ext, [by_left[c] for c in chain])
            chain, ext = [r], None

    stack: list[list] = []
    for i in range(1, n + 1):
        depth = _common(right[suffixes[i - 1]], right[suffixes[i]]) if i < n else -1
        node = [rank[suffixes[i - 1]]]
        while stack and stack[-1][0] > depth:
            closed = stack.pop()
            node = join(closed[1], node, closed[0])
            if group:
                report(node, closed[0])
        if stack and stack[-1][0] == depth:
            stack[-1][1] = join(stack[-1][1], node, depth)
        elif depth >= 0:
            stack.append([depth, node])
    return reach


_SPAN = pa.schema([("tkey", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])
_GROUP = pa.schema([("group_id", pa.string()), ("length", pa.int64()), ("tkey", pa.binary()), ("start", pa.int64())])


def _group_rows(rows: list[dict], min_len: int, sink=None):
    """Spans of one gram's occurrences; equal contexts are one entry of the array."""
    classes: dict[tuple[int, bytes], dict[tuple[bytes, int], None]] = {}
    for r in rows:
        classes.setdefault((r["lead"], r["context"]), {})[(r["tkey"], r["first"])] = None
    if len(classes) == 1 and sum(map(len, classes.values())) < 2:
        return
    items = list(classes.items())
    left = [context[:lead][::-1] for (lead, context), _ in items]
    right = [context[lead:] for (lead, context), _ in items]

    group = None
    if sink is not None:
        def group(length, ext, members):
            lead, context = items[members[0]][0]
            name = hashlib.md5(context[lead - ext:lead - ext + length]).hexdigest()
            sink.extend((name, length, tkey, first + items[m][0][0] - ext)
                        for m in members for tkey, first in items[m][1])
    reach = interval_scan(left, right, min_len, group)
    for ((lead, context), places), (ext, depth) in zip(items, reach):
        if len(places) > 1:  # the whole context occurs again
            if sink is not None:
                sink.extend((hashlib.md5(context).hexdigest(), len(context), *p) for p in places)
            ext, depth = lead, len(context) - lead
        if ext + depth >= min_len:
            for tkey, first in places:
                yield tkey, first + lead - ext, first + lead + depth


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("tkey"))


def _contexts(docs: DataFrame, min_len: int, gram: int):
    """Occurrences of grams that repeat ``(gram, tkey, first, lead, context)``,
    the grams' counts, the long texts that have copies, and a filter of ``tkey``
    that all texts with a repeat pass."""
    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, at, first, last, grams = [], [], [], [], []
            for tkey, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) < min_len:
                    continue
                p, f, e, g = anchors(data, min_len, gram)
                keys.append(tkey)
                for to, x in ((at, p), (first, f), (last, e), (grams, g)):
                    to.append(x)
            arr = lambda xs, t: pa.array(xs, pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), arr(at, pa.int32()), arr(first, pa.int32()), arr(last, pa.int32()),
                 arr(grams, pa.int64())], ["tkey", "at", "first", "last", "gram"])

    found = docs.select("tkey", "text").mapInArrow(
        lean(find), "tkey binary, at array<int>, first array<int>, last array<int>, gram array<bigint>")
    each = stored(found.select("tkey", F.arrays_zip("at", "first", "last", "gram").alias("a")), "anchors")
    copies = stored(each.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    # equal texts have equal anchors: those of one of them, a row for each place
    flat = each.dropDuplicates(["tkey"]).select("tkey", F.explode("a").alias("a")).select("tkey", "a.*")
    flat = stored(flat, "places")
    sizes = stored(flat.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    kept = stored(repeated(flat, sizes, ["gram"]).groupBy("tkey")
                  .agg(F.collect_list(F.struct("at", "first", "last", "gram", "n")).alias("a")), "kept")
    release(each, flat)
    has_repeat = key_filter(kept.select("tkey").unionByName(copies.select("tkey")), "tkey")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("tkey", pa.binary()), ("first", pa.int64()),
                            ("lead", pa.int32()), ("context", pa.binary())])
        seen: set[bytes] = set()  # equal texts give equal occurrences: one of a task is enough
        for batch in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            for tkey, text, a in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if tkey in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(tkey)
                data = text.as_buffer().to_pybytes()
                for x in a:
                    out["gram"].append(x["gram"])
                    out["n"].append(x["n"])
                    out["tkey"].append(tkey)
                    out["first"].append(x["first"])
                    out["lead"].append(x["at"] - x["first"])
                    out["context"].append(data[x["first"]:x["last"] + min_len])
                if len(out["gram"]) > 10_000:
                    yield from batches(out, schema)
                    out = {f.name: [] for f in schema}
            yield from batches(out, schema)

    long = docs.filter(F.octet_length("text") >= min_len).select("tkey", "text").filter(has_repeat(F.col("tkey")))
    cuts = long.join(kept, "tkey").select("tkey", "text", "a").mapInArrow(
        lean(cut), "gram bigint, n bigint, tkey binary, first bigint, lead int, context binary")
    return cuts, sizes, copies, has_repeat


def _gram_size(min_len: int) -> int:
    return max(1, min_len // 3)


def _spans(docs: DataFrame, min_len: int, group_rows: int):
    gram = _gram_size(min_len)
    cuts, sizes, copies, has_repeat = _contexts(docs, min_len, gram)
    hot = not sizes.filter(F.col("n") > group_rows).isEmpty()
    if hot:
        cuts = stored(cuts, "cuts")

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in _SPAN}
        for _, rows in sorted_groups(it, "gram"):
            for tkey, start, stop in _group_rows(rows, min_len):
                out["tkey"].append(tkey)
                out["start"].append(start)
                out["stop"].append(stop)
            if len(out["tkey"]) > 20_000:
                yield from batches(out, _SPAN)
                out = {f.name: [] for f in _SPAN}
        yield from batches(out, _SPAN)

    spans = cuts.filter(F.col("n") <= group_rows).select("gram", "tkey", "first", "lead", "context") \
        .repartition("gram").sortWithinPartitions("gram").mapInArrow(lean(scan), "tkey binary, start bigint, stop bigint")
    if hot:
        spans = spans.unionByName(_counted_windows(cuts.filter(F.col("n") > group_rows), min_len))
    return spans, copies, has_repeat


def _counted_windows(cuts: DataFrame, min_len: int) -> DataFrame:
    """Spans of hot grams: every window is a row (two 64-bit hashes), windows
    that occur at two places or more are spans.  Counting combines before the
    shuffle, so a repeat with many places costs one row a task."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("tkey", pa.binary()), ("start", pa.int64())])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for tkey, first, context in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(context.as_buffer(), np.uint8)
                h1, h2 = (gram_hashes(data, min_len, b).view(np.int64) for b in (_BASE, _BASE2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array([tkey.as_py()] * len(h1), pa.binary()),
                     pa.array(first.as_py() + np.arange(len(h1)))], schema=schema)

    rows = stored(cuts.dropDuplicates(["tkey", "first", "gram", "lead"]).select("tkey", "first", "context")
                  .mapInArrow(lean(windows), "h1 bigint, h2 bigint, tkey binary, start bigint")
                  .dropDuplicates(["tkey", "start"]), "windows")
    often = stored(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    return repeated(rows, often, ["h1", "h2"]).select("tkey", "start", (F.col("start") + min_len).alias("stop"))


def _cut_texts(docs: DataFrame, min_len: int, group_rows: int, columns: str, row) -> DataFrame:
    """``row(text bytes, maximal removed runs)`` for each document, beside its other columns."""
    spans, copies, has_repeat = _spans(docs, min_len, group_rows)
    spans = spans.groupBy("tkey").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    marks = copies.join(spans, "tkey", "full").select("tkey", F.col("copies").isNotNull().alias("whole"), "spans")
    # only texts that may have a repeat are shuffled
    joined = docs.filter(has_repeat(F.col("tkey"))).join(marks, "tkey", "left").drop("tkey")
    rest = [c for c in joined.columns if c not in ("text", "whole", "spans")]
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*rest).schema)

    k, has = len(rest), has_repeat.has

    def rows(batch: pa.RecordBatch, removed: Iterator[list[list[int]]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        for text, runs in zip(batch.column(k), removed):
            for to, v in zip(out, row(text.as_buffer().to_pybytes(), runs)):
                to.append(v)
        return pa.RecordBatch.from_arrays([*batch.columns[:k], *map(pa.array, out)], [*rest, *names])

    def merged(size: int, whole: bool | None, spans: list[dict] | None) -> list[list[int]]:
        runs: list[list[int]] = [[0, size]] if whole else []
        for s in sorted((s["start"], s["stop"]) for s in (spans or []) if not whole):
            if runs and s[0] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s[1])
            else:
                runs.append(list(s))
        return runs

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(it, k):
            sizes = pc.binary_length(batch.column(k)).to_pylist()
            yield rows(batch, map(merged, sizes, batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist()))

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the filter is asked here: as an expression of its own it would be a second worker beside each of these
        for batch in by_bytes(it, k):
            rest_of = batch.filter(pa.array(~has(batch.column(k + 1).to_numpy(), batch.column(k + 2).to_numpy())))
            if rest_of.num_rows:
                yield rows(rest_of, ([] for _ in range(rest_of.num_rows)))
    one, two = filter_bits(F.col("tkey"))
    return joined.select(*rest, "text", "whole", "spans").mapInArrow(lean(run), f"{types}, {columns}").unionByName(
        docs.select(*rest, "text", one.alias("_one"), two.alias("_two")).mapInArrow(lean(clean), f"{types}, {columns}"))


def _kept(data: bytes, runs: list[list[int]]) -> bytes:
    out, at = [], 0
    for start, stop in runs:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]])


def repeat_digest(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text",
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and
    ``kept_text``, what is left of it (without the rest of a character that
    lost some of its bytes)."""
    def row(data: bytes, runs):
        kept = _kept(data, runs)
        return len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")
    return _cut_texts(_texts(docs, id_col, text_col), min_len, group_rows,
                      "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string", row)


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, text_col: str = "text",
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with repeats cut from ``text_col``.  A character that loses
    some of its bytes is cut whole; documents without a word left go."""
    keep = [c for c in docs.columns if c != text_col]
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = _cut_texts(_texts(renamed, "doc_id", "text"), min_len, group_rows, "cut string",
                     lambda data, runs: [_kept(data, runs).decode("utf-8", "ignore")])
    cols = [F.col("cut").alias(text_col) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns]
    return out.filter(F.col("cut").rlike("[^\\x20\\x09-\\x0D]")).select(*cols)


def repeat_groups(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeat groups: ``group_id, length, doc_id, start``, one row an
    occurrence, all occurrences of a group.  Lengths are measured inside the
    anchors' contexts (below ``2 * min_len`` bytes); a longer repeat is a chain
    of overlapping groups.  Equal texts are a group of their own, of the whole
    text; places of it inside other texts are in the groups of its contexts.
    One gram's occurrences are held by one task."""
    texts = _texts(docs, id_col, text_col)
    cuts, _, copies, _ = _contexts(texts, min_len, _gram_size(min_len))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(it, "gram"):
            found: list[tuple] = []
            for _ in _group_rows(rows, min_len, found):
                pass
            if found:
                yield from batches(dict(zip(_GROUP.names, map(list, zip(*found)))), _GROUP)
    groups = cuts.repartition("gram").sortWithinPartitions("gram") \
        .mapInArrow(scan, "group_id string, length bigint, tkey binary, start bigint")
    whole = texts.join(copies, "tkey", "left_semi") \
        .select(F.lower(F.hex("tkey")).alias("group_id"), F.octet_length("text").cast("long").alias("length"), "tkey",
                F.lit(0).cast("long").alias("start"))
    groups = groups.unionByName(whole).distinct()
    return groups.join(texts.select("tkey", "doc_id"), "tkey").select("group_id", "length", "doc_id", "start")
