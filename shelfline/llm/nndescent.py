"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph has an edge from every distinct vector to its ``k`` most similar
ones found so far.  It starts from chunks of a few random hyperplane tables
and is improved by NN-descent: each node's neighbours, forward and (sampled)
backward, meet in a local join, are compared with each other, that is with
neighbours of neighbours, and pairs that beat a node's worst neighbour are
merged into its list.  Only pairs with an edge that is new since the last
round are compared; rounds go on until few edges change.

A search starts from the query's own neighbours in the graph and those that
share its hyperplane chunks, and repeatedly expands the nodes among its
``beam`` best that are not yet expanded, all queries at once, one Spark join a
step, until there are none.  Lists and beam grow with the logarithm of the
number of vectors.  The best candidates are scored exactly, in double
precision, on the original vectors.

Equal vectors are one node, so thousands of copies neither fill a list nor a
task; the copies come back by their smallest ids.  Lists live in tables of
edges; vectors move as half-precision unit vectors beside the edges that need
them.  Nothing but counts comes to the driver.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most take no part, neither do null
ids; of repeated ids the rows with the smallest vector bytes count; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Lengths of the lists and of the beam: at least, and for each doubling of the vectors.
K, K_STEP = 24, 2
BEAM, BEAM_STEP = 128, 12
TABLES = 6
CHUNK = 256
#: Rounds end when a smaller share of the edges is new.
SETTLED = 0.02
#: Found nodes of a query that are scored exactly.
RESCORED = 24


def sizes(n: int) -> tuple[int, int]:
    """List length and beam for ``n`` distinct vectors."""
    doublings = max(1, n).bit_length()
    return max(K, K_STEP * doublings), max(BEAM, BEAM_STEP * doublings)


def _floats(column: pa.Array) -> list[np.ndarray | None]:
    """The valid vectors of a list column as doubles, others None."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = x.values if x.is_valid else None
        if v is None or len(v) == 0 or v.null_count:
            out.append(None)
            continue
        v = v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if np.isfinite(v).all() and np.any(v) else None)
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, dim, raw (doubles), unit (half precision)`` of the vectors that take part."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), _floats(batch.column(1))) if v is not None]
            unit = [(v / np.abs(v).max()) for _, v in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(v) for _, v in rows], pa.int32()),
                 pa.array([v.tobytes() for _, v in rows], pa.binary()),
                 pa.array([(u / np.linalg.norm(u)).astype(np.float16).tobytes() for u in unit], pa.binary())],
                ["id", "dim", "raw", "unit"])
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")) \
        .mapInArrow(run, "id bigint, dim int, raw binary, unit binary")
    rows = stored(rows, "vectors")
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    rows = rows.join(F.broadcast(most), "dim", "left_semi")
    return stored(rows.groupBy("id").agg(F.min(F.struct("raw", "unit")).alias("x")).select("id", "x.*"), "vectors")


def _units(column: pa.Array) -> np.ndarray:
    """Half-precision vectors of a binary column as one float32 matrix."""
    if not len(column):
        return np.zeros((0, 1), np.float32)
    width = len(column[0].as_buffer())
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), np.float16)
    return flat.reshape(-1, width // 2).astype(np.float32)


def _runs(it: Iterator[pa.RecordBatch], key: str, rows: int = 60_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key`` (null-free longs)."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole[key].to_numpy()
        at = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if at:
            yield whole.slice(0, at)
            held = whole.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _chunks(t: pa.Table, *names: str) -> list:
    return [t[n].combine_chunks() if t[n].num_chunks != 1 else t[n].chunk(0) for n in names]


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each ``a`` the ``k`` best distinct ``b`` (smaller ``b`` on ties)."""
    order = np.lexsort((-sim, b, a))
    a, b, sim, more = a[order], b[order], sim[order], [m[order] for m in more]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    a, b, sim, more = a[first], b[first], sim[first], [m[first] for m in more]
    order = np.lexsort((b, -sim, a))
    a, b, sim, more = a[order], b[order], sim[order], [m[order] for m in more]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    keep = nth < k
    return a[keep], b[keep], sim[keep], *[m[keep] for m in more]


_EDGE = "id bigint, nbr bigint, sim float"


def _edge_batch(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())],
                                      ["id", "nbr", "sim"])


def _first_edges(nodes: DataFrame, n: int, k: int, tables: int, chunk: int, seed: int) -> DataFrame:
    """Edges inside the chunks of random hyperplane tables: a node's bucket is
    the signs of its random projections; large buckets are cut along one more."""
    bits = max(0, int(math.log2(max(1, n / chunk))))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _units(batch.column(1))
            for t in range(tables):
                r = np.random.default_rng(seed * 1000 + t)
                code = ((x @ r.normal(size=(x.shape[1], bits))) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x))
                along = x @ r.normal(size=x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(code.astype(np.int64) * tables + t),
                     pa.array(along.astype(np.float32))], ["id", "unit", "bucket", "along"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, units = None, [], []

        def compare():
            if len(ids) < 2:
                return
            own = np.array(ids)
            x = np.frombuffer(b"".join(units), np.float16).reshape(len(ids), -1).astype(np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -3)
            take = min(k, len(own) - 1)
            best = np.argpartition(-s, take - 1, axis=1)[:, :take]
            yield _edge_batch(np.repeat(own, take), own[best].ravel(), np.take_along_axis(s, best, 1).ravel())
        for batch in it:
            for i, u, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b != last or len(ids) >= chunk:
                    yield from compare()
                    last, ids, units = b, [], []
                ids.append(i)
                units.append(u)
        yield from compare()
    placed = nodes.select("id", "unit").mapInArrow(place, "id bigint, unit binary, bucket bigint, along float")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "along", "id").select("id", "unit", "bucket") \
        .mapInArrow(meet, _EDGE)


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """Best ``k`` edges of each node from ``id, nbr, sim, old``; ``fresh``: not there before."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(it, "id"):
            a, b, s, old = (x.to_numpy(zero_copy_only=False) for x in _chunks(t, "id", "nbr", "sim", "old"))
            # the old row of a pair comes first among equals
            a, b, s, old = _best(a, b, s.astype(np.float64) + old * 1e-9, k, old)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32)), pa.array(old == 0)],
                                             ["id", "nbr", "sim", "fresh"])
    return edges.repartition("id").sortWithinPartitions("id").mapInArrow(run, _EDGE + ", fresh boolean")


def _meetings(graph: DataFrame, k: int, round_: int) -> DataFrame:
    """``at, member, fresh``: who meets in each node's local join: its neighbours
    and at most ``k`` of the nodes that have it as neighbour.  The row limit of
    the window is applied before the shuffle too, so a hub sends ``k`` rows a
    task."""
    back = graph.select(F.col("nbr").alias("at"), F.col("id").alias("member"), "fresh",
                        F.xxhash64("id", F.lit(round_)).alias("h"))
    few = Window.partitionBy("at").orderBy(F.desc("fresh"), "h", "member")
    back = back.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k)
    own = graph.select(F.col("id").alias("at"), F.col("nbr").alias("member"), "fresh")
    return own.unionByName(back.select("at", "member", "fresh")).groupBy("at", "member").agg(F.max("fresh").alias("fresh"))


def _local_join(meetings: DataFrame, nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Edges that the local joins find and that beat the worst edge of their node."""
    worst = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-3.0)).alias("worst"))
    known = nodes.select("id", "unit").join(worst, "id", "left") \
        .select(F.col("id").alias("member"), "unit", F.coalesce("worst", F.lit(-3.0)).cast("float").alias("worst"))
    rows = meetings.join(known, "member").repartition("at").sortWithinPartitions("at") \
        .select("at", "member", "fresh", "worst", "unit")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(it, "at"):
            at, member, fresh, worst, unit = _chunks(t, "at", "member", "fresh", "worst", "unit")
            at, member, fresh, worst = (x.to_numpy(zero_copy_only=False) for x in (at, member, fresh, worst))
            x = _units(unit)
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                s = x[lo:hi] @ x[lo:hi].T
                better = (s > worst[lo:hi, None]) & (fresh[lo:hi, None] | fresh[None, lo:hi])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                out[0].append(member[lo + i])
                out[1].append(member[lo + j])
                out[2].append(s[i, j])
            if out[0]:
                a, b, s = (np.concatenate(o) for o in out)
                yield _edge_batch(*_best(a, b, s, k))
    return rows.mapInArrow(run, _EDGE)


def neighbour_graph(nodes: DataFrame, n: int, first: DataFrame, k: int = K) -> DataFrame:
    """NN-descent graph ``id, nbr, sim, fresh`` over the distinct vectors ``id, unit``
    from the ``first`` edges."""
    old = lambda df, flag: df.select("id", "nbr", "sim", F.lit(flag).cast("int").alias("old"))
    graph = stored(_merged(old(first, 0), k), "graph")
    # a list only changes for the better, so the rounds come to an end
    for round_ in count():
        found = _local_join(_meetings(graph, k, round_), nodes, graph, k)
        graph = stored(_merged(old(graph, 1).unionByName(old(found, 0)), k), "graph")
        if graph.filter("fresh").count() <= SETTLED * k * n:
            break
    return graph


def _similarities(pairs: DataFrame) -> DataFrame:
    """``q, node, sim`` of ``q, node, qunit, unit``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = np.einsum("ij,ij->i", _units(batch.column(2)), _units(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float32())], ["q", "node", "sim"])
    return pairs.select("q", "node", "qunit", "unit").mapInArrow(run, "q bigint, node bigint, sim float")


def greedy_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM, k: int = K,
                  first: DataFrame | None = None) -> DataFrame:
    """``q, node, sim``: the beam of each query node ``q`` when all its nodes are
    expanded; it starts from the edges of ``q`` in ``graph`` and ``first``."""
    links = stored(_meetings(graph, k, -1).select(F.col("at").alias("id"), F.col("member").alias("nbr")), "links")
    asked = queries.join(nodes, queries["q"] == nodes["id"]).select("q", F.col("unit").alias("qunit"))
    asked = stored(asked, "asked")
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    start = graph.select("id", "nbr", "sim")
    if first is not None:
        start = start.unionByName(first.select("id", "nbr", "sim"))
    seen = start.withColumnRenamed("id", "q").join(asked.select("q"), "q", "left_semi") \
        .groupBy("q", F.col("nbr").alias("node")).agg(F.max("sim").alias("sim")).withColumn("done", F.lit(False))
    while True:
        # the beam is all that the next step needs: a node that left it cannot come back
        seen = stored(seen.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r"), "seen")
        opened = seen.filter(~F.col("done")).select("q", "node")
        if opened.isEmpty():
            return seen.select("q", "node", "sim")
        pairs = opened.join(links, opened["node"] == links["id"]).select("q", F.col("nbr").alias("node")) \
            .filter("q <> node").distinct().join(seen.select("q", "node"), ["q", "node"], "left_anti") \
            .select("q", "node").join(nodes.select(F.col("id").alias("node"), "unit"), "node").join(asked, "q")
        found = _similarities(pairs).withColumn("done", F.lit(False))
        seen = seen.withColumn("done", F.lit(True)).unionByName(found) \
            .groupBy("q", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))


def _exact(pairs: DataFrame) -> DataFrame:
    """Cosine in double precision of the original vectors ``a`` and ``b``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer())
                out.append(float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())],
                                             ["query_id", "vec_id", "score"])
    return pairs.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int | None = None, beam: int | None = None, rescored: int = RESCORED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows found for each
    row for which the Column ``queries`` (over ``id``) holds; ``k`` and ``beam``
    are those of ``sizes`` unless given."""
    rows = usable(vectors, id_col, vec_col)
    # equal vectors are one node, named by their smallest id
    classes = rows.groupBy("raw").agg(F.min("id").alias("node"), F.min("unit").alias("unit"))
    nodes = stored(classes.select("raw", F.col("node").alias("id"), "unit"), "nodes")
    member = stored(rows.join(nodes.select("raw", F.col("id").alias("node")), "raw").select("id", "node"), "members")
    n = nodes.count()
    asked = stored(member.filter(queries).select(F.col("id").alias("query_id"), F.col("node").alias("q")), "queries")
    k, beam = (given or grown for given, grown in zip((k, beam), sizes(n)))
    first_edges = stored(_first_edges(nodes, n, k, TABLES, CHUNK, 1), "first")
    graph = neighbour_graph(nodes, n, first_edges, k)
    found = greedy_search(graph, nodes, asked.select("q").distinct(), beam, k, first_edges)
    first = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= rescored).select("q", "node")
    found = found.unionByName(asked.select("q", F.col("q").alias("node")).distinct())
    # of each node its smallest members, one more than asked for as a query leaves itself out
    named = Window.partitionBy("node").orderBy("id")
    least = member.withColumn("r", F.row_number().over(named)).filter(F.col("r") <= top + 1).select("node", F.col("id").alias("vec_id"))
    pairs = asked.join(found, "q").join(least, "node").filter("query_id <> vec_id").select("query_id", "q", "node", "vec_id")
    raw = nodes.select(F.col("id").alias("node"), F.col("raw").alias("b"))
    raw_q = nodes.select(F.col("id").alias("q"), F.col("raw").alias("a"))
    scored = _exact(pairs.join(raw, "node").join(raw_q, "q"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
