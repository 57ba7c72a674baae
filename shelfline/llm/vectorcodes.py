"""Product codes of vectors by exact Lloyd rounds with norm-of-sum bounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts``
equal consecutive parts, and each part position has a codebook.  All distances
are integers, so results do not depend on the order of rows or tasks.

A part keeps, besides its entry, the distance to that entry and for each group
of entries a lower bound on the distances to the other entries, every bound
with the number of the round in which it was measured (its stamp).  The driver
keeps the codebooks of all rounds, so a bound of round T is carried to round t
by the true net displacement ``|c_t - c_T|`` of the entries, the norm of the
sum of their steps, which is never above the sum of the steps' norms that
accumulated drifts would take off.  Only parts whose bounds cross are measured
again: first against their own entry, then against the groups of entries that
may still be nearer.

Each round reads the stored rows once, writes them with their new state, and
sums the parts by entry (a partial sum in each task); the driver sees one sum
for each entry and component.  State of an old round is deleted.

Defined results: null vectors and those with a null or non-finite component
are dropped, also those with a component of 2^26 / scale or more (their
squared distances would leave 64 bits) and those of another length than the
kept vector of the smallest id, or whose length ``parts`` does not divide; null
ids come last in the order of ids, equal ids are ordered by their vectors;
repeated rows are coded as often as they come; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries that share one lower bound.
GROUP = 32
#: Integers below this keep every sum of squares within 64 bits.
LARGEST = 1 << 26
#: Integers below this have exact squared distances in double precision.
_EXACT = 1 << 21
#: Relative slack of the comparisons of bounds, above the rounding of single precision.
_SLACK = 1e-6


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integer points."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def state_type(parts: int, groups: int) -> np.dtype:
    return np.dtype([("entry", "u1", (parts,)), ("stamp", "u1", (parts,)), ("near", "<f4", (parts,)),
                     ("low_stamp", "u1", (parts, groups)), ("low", "<f4", (parts, groups))])


class Codebooks:
    """The codebooks of every round so far (rounds x parts x entries x width)."""

    def __init__(self, first: np.ndarray, group: int = GROUP):
        self.history = [first]
        self.group = group
        self.parts, self.entries, self.width = first.shape
        self.groups = -(-self.entries // group)

    def renew(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Floored means of the parts; unused entries stay."""
        used = counts > 0
        mean = sums // np.maximum(counts, 1)[:, :, None]
        self.history.append(np.where(used[:, :, None], mean, self.history[-1]))

    def moved(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Net displacement from each round's entries to the present ones, and
        the largest of each group of entries."""
        now = self.history[-1][part].astype(np.float64)
        net = np.stack([np.sqrt(((now - old[part]) ** 2).sum(1)) for old in self.history])
        most = np.stack([net[:, g * self.group:(g + 1) * self.group].max(1) for g in range(self.groups)], axis=1)
        return net, most

    def assign(self, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, int]:
        """State of vectors ``x`` (rows x dimensions) in the present round, and
        how many parts were measured against whole groups."""
        new = np.zeros(len(x), state_type(self.parts, self.groups)) if state is None else state.copy()
        scans = 0
        for part in range(self.parts):
            own = x[:, part * self.width:(part + 1) * self.width]
            scans += self._part(part, own, new, first=state is None)
        return new, scans

    def _part(self, part: int, x: np.ndarray, state: np.ndarray, first: bool) -> int:
        t, book, rows = len(self.history) - 1, self.history[-1][part], np.arange(len(x))
        if first:
            todo, due = rows, np.ones((len(x), self.groups), bool)
        else:
            net, most = self.moved(part)
            entry = state["entry"][:, part]
            upper = state["near"][:, part].astype(float) + net[state["stamp"][:, part], entry]
            low = state["low"][:, part].astype(float)
            drift = most[state["low_stamp"][:, part], np.arange(self.groups)]
            slack = _SLACK * (upper[:, None] + low + drift)
            todo = np.flatnonzero((upper[:, None] + slack >= low - drift).any(1))
            if not len(todo):
                return 0
            exact = np.sqrt(((x[todo] - book[entry[todo]]) ** 2).sum(1).astype(float))
            state["near"][todo, part], state["stamp"][todo, part] = exact, t
            due = exact[:, None] + slack[todo] >= (low - drift)[todo]
            some = due.any(1)
            todo, due = todo[some], due[some]
        if not len(todo):
            return 0
        before = state["entry"][todo, part].astype(np.int64)
        far = np.iinfo(np.int64).max
        best = np.full(len(todo), far) if first else ((x[todo] - book[before]) ** 2).sum(1)
        held, winner = best.copy(), np.zeros(len(todo), np.int64) if first else before.copy()
        nearest = np.full((len(todo), self.groups), far)  # of each measured group, without the entry held before
        second = nearest.copy()
        for g in range(self.groups):
            at = np.flatnonzero(due[:, g])
            if not len(at):
                continue
            lo = g * self.group
            d = squared(x[todo[at]], book[lo:lo + self.group])
            if not first:
                inside = np.flatnonzero((before[at] >= lo) & (before[at] < lo + d.shape[1]))
                d[inside, before[at][inside] - lo] = far
            index = d.argmin(1)
            least = d[np.arange(len(at)), index]
            nearest[at, g] = least
            d[np.arange(len(at)), index] = far
            second[at, g] = d.min(1)
            better = (least < best[at]) | ((least == best[at]) & (lo + index < winner[at]))
            best[at] = np.where(better, least, best[at])
            winner[at] = np.where(better, lo + index, winner[at])
        # lower bounds: the measured groups anew, without the winner
        root = lambda v: np.where(v == far, np.inf, np.sqrt(v.astype(float)))
        fresh = root(nearest)
        won = winner // self.group
        changed = np.flatnonzero(winner != before) if not first else np.arange(len(todo))
        fresh[changed, won[changed]] = root(second[changed, won[changed]])
        low, low_stamp = state["low"][todo, part], state["low_stamp"][todo, part]
        low, low_stamp = np.where(due, fresh, low), np.where(due, t, low_stamp)
        if not first and len(changed):  # the entry held before joins the others of its group
            g = before[changed] // self.group
            old, stamp = low[changed, g].astype(float), low_stamp[changed, g]
            carried = np.where(stamp == t, old, old - self.moved(part)[1][stamp, g] - _SLACK * (old + 1))
            low[changed, g] = np.minimum(carried, np.sqrt(held[changed].astype(float)))
            low_stamp[changed, g] = t
        state["entry"][todo, part], state["near"][todo, part], state["stamp"][todo, part] = winner, np.sqrt(best.astype(float)), t
        state["low"][todo, part], state["low_stamp"][todo, part] = low, low_stamp
        return int(due.sum())

    def errors(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to its entries, summed over the parts."""
        total = np.zeros(len(x), np.int64)
        for part in range(self.parts):
            own = x[:, part * self.width:(part + 1) * self.width]
            total += ((own - self.history[-1][part][state["entry"][:, part]]) ** 2).sum(1)
        return total

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.dtype.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _states(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def integers(table: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, v)`` of the vectors that take part, as integers."""
    x = F.col("vector")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * scale) < LARGEST, F.lit(False)))  # NaN is above all numbers
    return table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")) \
        .filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine) \
        .select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("v"))


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 group: int = GROUP) -> DataFrame:
    """``vec_id, label, code`` (binary, one byte a part), ``error``,
    ``label_error`` and ``codebooks_sha256`` of every vector that takes part."""
    if not 1 <= entries <= 256 or rounds > 250:
        raise ValueError("a code has one byte a part, a stamp one byte")
    spark = table.sparkSession
    rows = stored(integers(table, scale, id_col, vector_col, label_col), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    by_id = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.orderBy(*by_id).select("v").limit(1).collect()
    if not first or len(first[0].v) % parts:
        return spark.createDataFrame([], f"vec_id {kind}, label {label}, code binary, error bigint, label_error bigint, "
                                         "codebooks_sha256 string")
    width = len(first[0].v) // parts
    rows_of = rows.filter(F.size("v") == parts * width)
    seeds = rows_of.orderBy(*by_id).select("v").limit(entries).collect()
    books = Codebooks(np.array([r.v for r in seeds], np.int64).reshape(-1, parts, width).transpose(1, 0, 2), group)
    layout = state_type(parts, books.groups)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                old = _states(batch.column(3), layout) if batch.num_columns > 3 else None
                new, _ = books.assign(_matrix(batch, 2), old)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(new)], ["vec_id", "label", "v", "state"])

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((books.parts, books.entries, width + 1), np.int64)
        for batch in it:
            if batch.num_rows:
                x, state = _matrix(batch, 2), _states(batch.column(3), layout)
                for part in range(parts):
                    entry = state["entry"][:, part]
                    np.add.at(total[part, :, width], entry, 1)
                    for at in range(width):
                        np.add.at(total[part, :, at], entry, x[:, part * width + at])
        slot = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(total.ravel()[slot])], ["slot", "s"])

    layout_sql = f"vec_id {kind}, label {label}, v array<int>, state binary"
    state = stored(rows_of.mapInArrow(step, layout_sql), "codes-0")
    release(rows)
    for t in range(1, rounds + 1):
        total = np.zeros(parts * books.entries * (width + 1), np.int64)
        for r in state.mapInArrow(sums, "slot bigint, s bigint").groupBy("slot").agg(F.sum("s").alias("s")).collect():
            total[r.slot] = r.s
        total = total.reshape(parts, books.entries, width + 1)
        books.renew(total[:, :, :width], total[:, :, width])
        renewed = stored(state.mapInArrow(step, layout_sql), f"codes-{t}")
        release(state)
        state = renewed

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                own = _states(batch.column(3), layout)
                error = books.errors(_matrix(batch, 2), own)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(np.ascontiguousarray(own["entry"]).view(f"V{parts}").ravel()),
                                                  pa.array(error)], ["vec_id", "label", "code", "error"])
    done = stored(state.mapInArrow(finish, f"vec_id {kind}, label {label}, code binary, error bigint"), "coded")
    release(state)
    totals = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return done.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label") \
        .withColumn("codebooks_sha256", F.lit(books.digest()))
