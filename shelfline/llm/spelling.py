"""Grouping of spelling variants with k-d trees over letter-count vectors.

Two words are near when one inserted, deleted or replaced code point makes one
into the other.  A word is the point of its letter counts (``DIMS``
coordinates; letters that share one only bring points closer), so near words
of equal length are at most 2 apart in the L1 distance and words whose lengths
differ by one at most 1.

For each word length the points are cut into boxes by a k-d tree: its top is
fitted on the driver to a bounded sample (``SAMPLE`` words; it only decides how
even the boxes are), every word is put into its box, and goes as a query to
the boxes of its own length within 2 and of the next length within 1 of it.
Each box grows its own k-d tree, prunes subtrees by the distance to their
bounding boxes, and verifies the order of the letters of what is left.  So a
pair of words is found once, whatever the vocabulary's size, and no group of
words is compared pair by pair.

Words of one box have about ``LEAF`` points; words with equal counts
(anagrams) cannot be parted and stay together.  The trees on the driver have at
most ``LEAVES`` boxes in all, from at most ``SAMPLE`` words.

Defined results: null text has no words; a null id is written as nothing in
the hash that decides on deletions; repeated rows count as often as they come;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, release, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Coordinates: one for each of a-z, six for all other code points.
DIMS = 32
LEAF, LEAVES, SAMPLE = 8192, 4096, 50_000
#: Points of a leaf of the tree inside a box.
SMALL = 48


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = 199,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the letter runs of whole texts, lower-cased (A-Z).  Of a
    run whose hash with its id is a multiple of ``drop_one_in`` one code point
    is deleted."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")) \
        .filter(F.length("run") >= min_length) \
        .select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % drop_one_in == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= min_length) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def letters(texts: list[str]) -> np.ndarray:
    """Code points (words x length) of words of one length."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors (words x DIMS)."""
    coordinate = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (DIMS - 26)).astype(np.int64)
    n = len(codes)
    flat = np.arange(n)[:, None] * DIMS + coordinate
    return np.bincount(flat.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def _halves(points: np.ndarray) -> tuple[int, int] | None:
    """Coordinate and value at which to part points most evenly, of the widest coordinate."""
    order = np.argsort(-points.var(axis=0), kind="stable")
    for d in order[:4]:
        values = np.sort(points[:, d])
        middle = values[(len(values) - 1) // 2]
        if middle == values[-1]:
            below = np.searchsorted(values, middle, "left") - 1
            middle = values[below] if below >= 0 else None
        if middle is not None:
            return int(d), int(middle)
    return None


class Tree:
    """k-d tree over count vectors.  ``tight`` nodes have the bounding box of
    their points; other boxes are bounded by the cuts alone, so that any
    further point lies in one of them."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.lo, self.hi, self.cut, self.child, self.members = [], [], [], [], []
        self.leaves: list[int] = []
        open_lo, open_hi = np.full(DIMS, -1, np.int32), np.full(DIMS, 1 << 30, np.int32)
        todo = [(np.arange(len(points)), open_lo, open_hi, None)]
        while todo:
            at, lo, hi, parent = todo.pop()
            node = len(self.lo)
            if parent is not None:
                self.child[parent[0]][parent[1]] = node
            own = points[at]
            self.lo.append(own.min(0) if tight else lo)
            self.hi.append(own.max(0) if tight else hi)
            cut = _halves(own) if len(at) > leaf else None
            self.cut.append(cut)
            self.child.append([-1, -1])
            self.members.append(at if cut is None else None)
            if cut is None:
                self.leaves.append(node)
                continue
            d, v = cut
            left = own[:, d] <= v
            low_hi, high_lo = hi.copy(), lo.copy()
            low_hi[d], high_lo[d] = v, v + 1
            todo.append((at[left], lo, low_hi, (node, 0)))
            todo.append((at[~left], high_lo, hi, (node, 1)))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf node, queries)`` for the leaves whose box is within ``radius`` of a query."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            q = queries[at]
            away = np.maximum(self.lo[node] - q, 0).sum(1) + np.maximum(q - self.hi[node], 0).sum(1)
            at = at[away <= radius]
            if not len(at):
                continue
            if self.cut[node] is None:
                yield node, at
            else:
                todo += [(c, at) for c in self.child[node]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` become those of ``b`` by one replacement (equal
    lengths) or one insertion (``b`` longer by one)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


_PAIR = "a string, a_n bigint, b string, b_n bigint"


def near_pairs(vocabulary: DataFrame, leaf: int = LEAF, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """``(a, a_n, b, b_n)``: every pair of near words of ``vocabulary(word, n)``
    (distinct words) once, the shorter word first, of equal lengths the smaller."""
    sized = vocabulary.withColumn("length", F.length("word"))
    large = sized.groupBy("length").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > leaf)
    drawn = sized.join(F.broadcast(large), "length").orderBy(F.xxhash64("word"), "word").limit(sample) \
        .select("length", "many", "word").collect()  # lengths above ``leaf`` words only
    of: dict[int, list[str]] = {}
    total = {r.length: r.many for r in drawn}
    for r in drawn:
        of.setdefault(r.length, []).append(r.word)
    budget = max(leaf, -(-sum(total.values()) // leaves))
    tops = {k: Tree(counts(letters(ws)), max(1, budget * len(ws) // total[k]), tight=False) for k, ws in of.items()}

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["box", "length", "own", "word", "n"]
        for batch in it:
            length = batch.column(2).to_numpy()
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                rows = batch.take(pa.array(at))
                points = None
                # own box as a point; boxes of this and the next length as a query
                for tree_length, radius in ((k, 2), (k + 1, 1)):
                    top = tops.get(int(tree_length))
                    found = [(0, np.arange(len(at)))]
                    if top is not None:
                        if points is None:
                            points = counts(letters(rows.column(0).to_pylist()))
                        found = top.search(points, radius)
                    for node, who in found:
                        if tree_length == k and top is not None:
                            inside = ((points[who] >= top.lo[node]) & (points[who] <= top.hi[node])).all(1)
                        else:
                            inside = np.full(len(who), tree_length == k)
                        some = rows.take(pa.array(who))
                        box = np.full(len(who), int(tree_length) << 32 | node, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(box), some.column(2), pa.array(inside),
                                                          some.column(0), some.column(1)], names)

    routed = sized.select("word", "n", "length").mapInArrow(
        route, "box bigint, length int, own boolean, word string, n bigint")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in arrow_groups(it):
            length = group.column("length").to_numpy()
            own = np.flatnonzero(group.column("own").to_numpy(zero_copy_only=False))
            if not len(own):
                continue
            texts, n = group.column("word"), group.column("n").to_numpy()
            b_codes = letters(texts.take(pa.array(own)).to_pylist())
            points = counts(b_codes)
            tree = Tree(points, SMALL, tight=True)
            here = length[own[0]]
            for size, radius in ((here, 2), (here - 1, 1)):
                asks = np.flatnonzero(length == size)
                if not len(asks):
                    continue
                names = texts.take(pa.array(asks)).to_pylist()
                a_codes = letters(names)
                q = counts(a_codes)
                for node, who in tree.search(q, radius):
                    member = tree.members[node]
                    for at in range(0, len(who), 4096 // 8):  # blocks of 512 queries with a leaf
                        block = who[at:at + 512]
                        for lo in range(0, len(member), 512):
                            some = member[lo:lo + 512]
                            apart = np.abs(q[block][:, None, :] - points[some][None, :, :]).sum(2)
                            x, y = np.nonzero(apart <= radius)
                            x, y = block[x], some[y]
                            good = one_edit(a_codes[x], b_codes[y])
                            x, y = asks[x[good]], own[y[good]]
                            if size == here:  # both words ask: keep the pair of the smaller one
                                first = np.array([texts[int(i)].as_py() < texts[int(j)].as_py() for i, j in zip(x, y)], bool)
                                x, y = x[first], y[first]
                            if len(x):
                                take = lambda c, i: c.take(pa.array(i)).combine_chunks()
                                yield pa.RecordBatch.from_arrays([take(texts, x), pa.array(n[x]), take(texts, y), pa.array(n[y])],
                                                                 ["a", "a_n", "b", "b_n"])
    return routed.repartition("box").sortWithinPartitions("box").mapInArrow(search, _PAIR)


def spelling_variants(vocabulary: DataFrame, factor: int = FACTOR, leaf: int = LEAF) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of ``vocabulary(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest) if that is
    at least ``factor`` times the word's; ``root`` is the end of the chain of
    forms, found by doubling, as each step of a chain multiplies ``n``."""
    vocabulary = stored(vocabulary.select("word", "n"), "words")
    pairs = stored(near_pairs(vocabulary, leaf), "near")
    both = pairs.select("a", F.col("b").alias("near"), F.col("b_n").alias("near_n")) \
        .unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy(F.col("a").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * factor
    each = stored(vocabulary.join(best, "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(fits, F.col("best.near")).alias("form"),
                          F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    release(pairs, vocabulary)
    roots = each.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        release(roots)
        roots, moved = step.drop("moved"), not step.filter("moved").isEmpty()
        roots._stored_at = step._stored_at
        if not moved:
            break
    return each.join(roots, "word", "left") \
        .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
