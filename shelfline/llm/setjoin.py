"""Jaccard join of documents' shingle sets with R-trees over count vectors.

A document is the set of its distinct word shingles (64-bit hashes).  The
tokens of a set are hashed into groups (``GROUPS``, more for large sets), and the numbers of its
tokens in the groups are a point.  Of two sets no more tokens can be equal than
the sum of the smaller coordinates of their points, and of a set and any set
in a rectangle no more than the sum of the minima with the rectangle's upper
corner.  So a tree of rectangles (an R-tree packed in the order of the points)
is searched from the top with this bound and with the bound on sizes; points
that survive both are verified on the sets themselves.

One tree over all documents cannot prune its top: a link may differ by 16 % of
a set anywhere.  So points are first dealt by the tokens that any linked set
must share one of, the ``|A| - ceil(85 % of |A|) + 1`` rarest, where a token is
as rare as its cell of a count of fixed size (``CELLS``).  Every token that two
different sets have among their rarest is a tree of its own; of tokens with the
same sets one is enough.  A pair of sets belongs to the first tree that both
are in, largest trees first, so it is looked at once (``BEFORE`` trees of each
set are known to the others; a pair that meets in later ones only may be looked
at again).  Trees above ``PART_POINTS`` points are dealt to several tasks, as
pairs of parts.

The trees are searched on the points alone first; whole sets are sent only
where a point has another within the bound (in parts of ``PART_TOKENS``).
Only components are asked for, so pairs of sets that are connected already are
not verified: the first two trees of each set are verified, then the points of
the rest are searched again for pairs of different components, and the sets of
these are sent.  Each search returns a spanning forest of its links, never all
pairs.

Defined results: equal sets are one set (128-bit digest); null texts and
texts without words have an empty set and are linked with nothing; null ids
keep their component but never name it (a component of null ids has a null
one); repeated rows are returned as often as they come; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, components, release, stored
from .suffixes import _BASE, _power_tables

SHINGLE, PERCENT = 4, 85
GROUPS = 64
#: Cells of the count that orders tokens by rarity: 2 MB, whatever the corpus.
CELLS = 1 << 18
#: Points (128 bytes, or an eighth of their set's) that one task holds of a tree, and tokens (8 bytes each).
PART_POINTS = 16_384
PART_TOKENS = 2_000_000
FANOUT = 16
#: Bits of the Bloom filter of texts whose whole set is needed: 2 MB, whatever the corpus.
BLOOM = 1 << 24
#: Earlier trees of a set that its point carries into a tree (8 bytes each).
BEFORE = 32

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words of UTF-8 bytes, by running sums."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1, _BASE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[:len(data)], out=sums[1:])
    h = (sums[stop] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the lower-cased (A-Z)
    ``text``: the words' hashes, chained in order and mixed."""
    each = _words(np.frombuffer((text or "").encode(), np.uint8))
    if not len(each):
        return np.empty(0, np.uint64)
    size = min(shingle, len(each))
    n = len(each) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _STEP + each[k:k + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = np.sort(h ^ (h >> np.uint64(29)))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)


def rarity(docs: DataFrame, shingle: int, text_col: str) -> np.ndarray:
    """How many sets' tokens fall into each cell, over all documents."""
    chunk = 4096

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in it:
            held: list[np.ndarray] = []
            for at, text in enumerate(batch.column(0)):
                held.append(_cells(shingle_set(text.as_py(), shingle)))
                if len(held) == 500 or at + 1 == batch.num_rows:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held = []
        for at in range(0, CELLS, chunk):
            if total[at:at + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at:at + chunk].tobytes()])], ["at", "n"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["at", "n"])
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "at bigint, n binary")
    out = np.zeros(CELLS, np.int64)
    for r in parts.repartition(CELLS // chunk, "at").mapInArrow(add, "at bigint, n binary").collect():
        out[r.at:r.at + chunk] = np.frombuffer(r.n, np.int64)
    return out


def needed(size: int, percent: int) -> int:
    """Tokens that a set of ``size`` shares with any set it is linked with, at least."""
    return -(-percent * size // 100)


def narrow(docs: DataFrame, counts: np.ndarray, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tkey`` (of the text), ``n_shingles``, ``cls`` (digest of the set, null: empty),
    ``rare``, the tokens any linked set shares one of, and ``point``."""
    kind = docs.schema[id_col].dataType.simpleString()
    order = counts.astype(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, names, rare, points = [], [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), shingle)
                sizes.append(len(tokens))
                names.append(hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None)
                first = np.lexsort((tokens, order[_cells(tokens)]))[:len(tokens) - needed(len(tokens), percent) + 1]
                rare.append(tokens[first].view(np.int64))
                points.append(pack_point(point(tokens, group_count(len(tokens)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                                              pa.array(names, pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                                             ["doc_id", "tkey", "n_shingles", "cls", "rare", "point"])
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("tkey"), text.alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, tkey binary, n_shingles bigint, cls binary, rare array<bigint>, point binary")


def group_count(size: int) -> int:
    """Groups of a set of ``size`` tokens, a power of two: unrelated sets differ by about
    2 * sqrt(size * groups / pi) in their counts, which has to stay above the
    ``size / 6`` that a link may differ by."""
    return max(GROUPS, 1 << (size // 16).bit_length())


def point(tokens: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Numbers of the tokens in their groups."""
    return np.bincount((tokens % np.uint64(groups)).astype(np.int64), minlength=groups)


def pack_point(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint16).tobytes()


def unpack_points(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in packed]


def fold(points: list[np.ndarray], groups: int) -> np.ndarray:
    """Points of ``groups`` groups from points of as many or more."""
    return np.stack([p.reshape(-1, groups).sum(0) for p in points])


class CountTree:
    """R-tree over the points of sets: nodes of ``FANOUT`` children in the order
    of size and heaviest groups, each with its upper corner and range of sizes."""

    def __init__(self, points: np.ndarray, percent: int):
        self.percent = percent
        sizes = points.sum(1)
        # points alike come to lie side by side: by size in steps of the slack, then by their groups
        step = np.floor(np.log(sizes) / -np.log(percent / 100)).astype(np.int64)
        widest = np.argsort(-points.var(0), kind="stable")[:8]
        self.order = np.lexsort((*points[:, widest[::-1]].T, step))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, least, most = self.levels[-1]
            cuts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def search(self, q: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that may be linked with the point ``q``."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            share = np.minimum(top[at], q).sum(1)
            least, most = least[at], most[at]
            # 100 shared >= percent * (both sizes - shared), with the smallest size of the node
            low = np.maximum(least, needed(size, self.percent))
            at = at[((100 + self.percent) * share >= self.percent * (size + low))
                    & (100 * size >= self.percent * least) & (100 * most >= self.percent * size)]
            if depth and len(at):
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
            if not len(at):
                break
        return self.order[at]


def forest(sets: list[np.ndarray], known: list, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between ``sets`` that connect all their components.  ``known`` names
    components connected before; ``sides`` (0, 1): only pairs of different sides."""
    up: dict = {k: k for k in known}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    points = np.stack([point(s) for s in sets])
    lengths = np.array([len(s) for s in sets])
    tree = CountTree(points, percent) if len(sets) > 2 * FANOUT else None
    out = []
    for i, own in enumerate(sets):
        if tree is None:
            share = np.minimum(points[i + 1:], points[i]).sum(1)
            near = i + 1 + np.flatnonzero((100 + percent) * share >= percent * (lengths[i] + lengths[i + 1:]))
        else:
            near = tree.search(points[i], len(own))
            near = near[near > i]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        mine = top(known[i])
        near = [int(j) for j in near if top(known[j]) != mine]
        for at in range(0, len(near), 256):
            block = [j for j in near[at:at + 256] if top(known[j]) != top(known[i])]
            if not block:
                continue
            everything = np.concatenate([sets[j] for j in block])
            where = np.minimum(np.searchsorted(own, everything), len(own) - 1)
            same = np.add.reduceat((own[where] == everything).astype(np.int64), np.cumsum([0, *lengths[block[:-1]]]))
            for j, s in zip(block, same.tolist()):
                if 100 * s >= percent * (len(own) + int(lengths[j]) - s):
                    a, b = top(known[i]), top(known[j])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((i, j))
    return out


def possible(points: list[np.ndarray], comps: list, percent: int, sides: np.ndarray | None = None,
             before: list[np.ndarray] | None = None) -> np.ndarray:
    """Whether each point has another within the bound, of another component and
    side and without a common number in ``before`` (earlier trees of each point).

    Linked sets have as many groups or twice as many: for each number of groups
    there is a tree of the points that have so many, and of those that have
    twice as many, folded."""
    number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    width = np.array([len(p) for p in points])
    out = np.zeros(len(points), bool)
    earlier = np.zeros((len(points), max(map(len, before), default=0) if before else 0), np.int64)
    known = np.zeros(earlier.shape, bool)
    for k, own in enumerate(before or []):
        earlier[k, :len(own)], known[k, :len(own)] = own, True
    for groups in np.unique(width):
        here = np.flatnonzero((width == groups) | (width == 2 * groups))
        own = fold([points[i] for i in here], int(groups))
        tree, sizes = CountTree(own, percent), own.sum(1)
        wider = bool((width[here] != groups).any())  # those only meet the others in this tree
        for k, i in enumerate(here):
            if width[i] != groups or out[i] and not wider:
                continue
            near = here[tree.search(own[k], int(sizes[k]))]
            near = near[comp[near] != comp[i]]
            if sides is not None:
                near = near[sides[near] != sides[i]]
            if out[i]:
                near = near[~out[near]]
            if len(near) and known[i].any():
                near = near[~(np.isin(earlier[near], earlier[i][known[i]]) & known[near]).any(1)]
            out[i] |= len(near) > 0
            out[near] = True
    return out


def _dealt(trees: DataFrame, weight: str, limit: int) -> DataFrame:
    """``trees(token, cls, comp, ...)`` dealt to tasks: trees of up to ``limit`` by
    the sum of ``weight`` whole, others as pairs of parts, a row to each pair of
    its own part (``alone``: both are one part; ``high``: the second)."""
    parts = trees.groupBy("token").agg(F.ceil(F.sum(weight) / limit).alias("_parts"))
    rest = [c for c in trees.columns if c not in ("token", weight)]
    part = F.pmod(F.xxhash64("cls"), F.col("_parts"))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1),
                                 lambda o: F.struct(F.least("_part", o).alias("lo"), F.greatest("_part", o).alias("hi"))))
    rows = trees.join(parts, "token").withColumn("_part", part).select("token", *rest, "_part", pair.alias("_p"))
    return rows.select("token", F.xxhash64("token", "_p.lo", "_p.hi").alias("task"), F.concat_ws("/", "token", "_p.lo", "_p.hi").alias("tree"),
                       *rest, (F.col("_part") == F.col("_p.hi")).alias("high"), (F.col("_p.lo") == F.col("_p.hi")).alias("alone"))


def _sides(group: pa.Table) -> np.ndarray | None:
    return None if group.column("alone")[0].as_py() else np.array(group.column("high").to_pylist())


def in_order(postings: DataFrame) -> DataFrame:
    """``token, cls, at, before`` of ``postings(token, cls, n)``: the place of the tree
    among those of the set, largest (``n``) first, and the first ``BEFORE`` of the earlier ones."""
    lists = postings.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "token"))).alias("all"))
    return lists.select("cls", F.slice("all.token", 1, BEFORE).alias("head"), F.posexplode("all.token").alias("at", "token")) \
        .select("token", "cls", "at", F.expr(f"slice(head, 1, least(at, {BEFORE}))").alias("before"))


def candidates(trees: DataFrame, points: DataFrame, percent: int, part_points: int = PART_POINTS) -> DataFrame:
    """Rows ``(token, cls)`` of ``trees(token, cls, comp, before)`` whose point in
    ``points(cls, point)`` has another of its tree within the bound, of another
    component and in no earlier tree."""
    rows = _dealt(trees.withColumn("one", F.lit(1)), "one", part_points).join(points, "cls") \
        .repartition("task").sortWithinPartitions("tree").select("tree", "token", "cls", "comp", "point", "before", "high", "alone")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in arrow_groups(it):
            before = [x.values.to_numpy() for x in group.column("before")]
            hit = possible(unpack_points(group.column("point").to_pylist()), group.column("comp").to_pylist(), percent, _sides(group), before)
            if hit.any():
                some = group.filter(pa.array(hit)).select(["token", "cls"]).combine_chunks()
                yield from some.to_batches()
    return rows.mapInArrow(run, "token bigint, cls binary").distinct()


def search(trees: DataFrame, sets: DataFrame, percent: int, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Links ``(a, b)`` of a spanning forest in each tree of ``trees(token, cls, comp)``;
    ``sets(cls, n, tokens)``."""
    dealt = _dealt(trees.join(sets.select("cls", "n"), "cls"), "n", part_tokens)
    rows = dealt.join(sets.select("cls", "tokens"), "cls").repartition("task").sortWithinPartitions("tree", "cls") \
        .select("tree", "cls", "comp", "high", "alone", "tokens")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in arrow_groups(it):
            names, comps = group.column("cls").to_pylist(), group.column("comp").to_pylist()
            if len(set(comps)) < 2:
                continue
            tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens")]
            found = forest(tokens, comps, percent, _sides(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.binary()),
                                                  pa.array([names[j] for _, j in found], pa.binary())], ["a", "b"])
    return rows.mapInArrow(run, "a binary, b binary")


def _bits() -> list:
    return [F.pmod(F.xxhash64(F.lit(k), "tkey"), F.lit(BLOOM)) for k in (1, 2)]


def whole_sets(keyed: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``tkey, n, tokens`` of the texts of ``keyed(text, tkey)`` that a Bloom filter
    of ``texts(tkey)`` lets through: some more than asked for, none missing, copies
    once a task.  The filter has a fixed size; when it is full, more texts pass."""
    bit = F.explode(F.array(*_bits())).alias("bit")
    words = texts.select(bit).groupBy(F.shiftright("bit", 6).alias("at")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    bloom = np.zeros(BLOOM // 64, np.uint64)
    bloom[[r.at for r in words]] = np.array([r.bits for r in words], np.int64).view(np.uint64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in it:
            ok = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                bit = batch.column(c).to_numpy()
                ok &= (bloom[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for at in np.flatnonzero(ok).tolist():  # a row at a time: texts may be long
                key = batch.column(0)[at].as_py()
                if key in seen:
                    continue
                seen.add(key)
                own = shingle_set(batch.column(1)[at].as_py(), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([len(own)], pa.int64()),
                                                  pa.array([own.tobytes()], pa.binary())], ["tkey", "n", "tokens"])
    one, two = _bits()
    return keyed.select("tkey", "text", one.alias("one"), two.alias("two")).mapInArrow(run, "tkey binary, n bigint, tokens binary")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text", part_points: int = PART_POINTS,
                       part_tokens: int = PART_TOKENS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (smallest id reachable by links) of every document."""
    spark = docs.sparkSession
    counts = rarity(docs, shingle, text_col)
    each = stored(narrow(docs, counts, shingle, percent, id_col, text_col), "sets")
    tokens = each.filter("cls is not null").select("cls", F.explode("rare").alias("token"))
    mark = F.xxhash64("cls")
    shared = tokens.groupBy("token").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("token")
    postings = stored(tokens.join(shared, "token").distinct(), "postings")
    # of tokens with the same sets one is enough
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"),
                                          F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
    once = stored(in_order(postings.join(lists.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n"), "token")), "once")
    release(postings)
    points = each.filter("cls is not null").groupBy("cls").agg(F.first("point").alias("point"))
    trees = stored(candidates(once.drop("at").withColumn("comp", F.col("cls")), points, percent, part_points), "trees")

    # whole sets of the classes left, from one text of each
    texts = stored(each.join(trees.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("tkey").alias("tkey")), "texts")

    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("tkey"))
    sets = stored(whole_sets(keyed, texts, shingle).join(texts, "tkey").dropDuplicates(["tkey"])
                  .select("cls", "n", "tokens"), "whole")  # one text of each class, copies already lie side by side
    release(texts)

    # the first two trees of each set, then those whose points still hold two components
    few = trees.join(once, ["token", "cls"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("all"))
    few = few.select("cls", F.explode(F.slice("all.token", 1, 2)).alias("token"))
    first = stored(search(few.withColumn("comp", F.col("cls")), sets, percent, part_tokens), "links")
    comp = components(spark, first)
    named = trees.join(comp, trees.cls == comp.node, "left").select("token", "cls", F.coalesce("root", "cls").alias("comp"))
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = stored(named.join(mixed, "token"), "left")
    left = candidates(rest.join(once.drop("at"), ["token", "cls"]), points, percent, part_points)
    second = stored(search(rest.join(left, ["token", "cls"]), sets, percent, part_tokens), "links")
    release(sets, trees, once, rest)
    roots = components(spark, first.unionByName(second))
    classes = each.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    member = classes.join(roots, classes.cls == roots.node, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    of = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    return each.join(of, "cls", "left") \
        .select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
