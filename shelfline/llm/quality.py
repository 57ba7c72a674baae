"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of
the whole text is encoded as a vector: the shares of its byte values, of
hashed words, and counts of repeats and word lengths.  A small network maps a
passage to a hidden vector, gated attention (``tanh`` times ``sigmoid``)
weighs the passages of a document, and the weighted mean is scored.  Only
document labels train it: the attention learns which passages tell.

Fitting uses a bounded sample of labelled rows (``sample``, drawn by the hash
of the id) and of each at most ``SAMPLE_PASSAGES`` passages, drawn by the hash of
their number, so the driver holds a bounded set of vectors; scoring reads each
whole text once, without a shuffle.

Defined results: null and empty texts are one passage without words; null ids
and rows without a label are scored but not learned from; of several labels of
an id the largest counts, of several texts the one whose vectors are smallest
as bytes; without any label the score is 0.5, with one class only the model
learns that class; extra columns are kept by ``score``, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean
from .suffixes import _BASE, _power_tables

PASSAGE_WORDS = 64
#: Labelled documents that a fit reads, and passages of each.
SAMPLE = 4000
SAMPLE_PASSAGES = 16
HASHED = 96
HIDDEN = 24
EPOCHS = 40
_CLASSES = 129  # ASCII byte values and one for all others
_EXTRA = 6
WIDTH = _CLASSES + HASHED + _EXTRA
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.minimum(np.arange(256), 128)


def passages(text: str | None, words: int = PASSAGE_WORDS) -> np.ndarray:
    """Feature vectors (passages x WIDTH) of a whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(start) // words)
    owner = np.arange(len(start)) // words
    first = start[::words]
    byte_owner = np.searchsorted(first, np.arange(len(data)), "right") - 1 if n > 1 else np.zeros(len(data), np.int64)
    byte_owner = np.maximum(byte_owner, 0)
    chars = np.bincount(byte_owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    size = np.maximum(chars.sum(1, keepdims=True), 1)

    power, inverse = _power_tables(len(data) + 1, _BASE)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    name = (sums[stop] - sums[start]) * inverse[start]
    name ^= name >> np.uint64(31)
    name *= np.uint64(0x9E3779B97F4A7C15)
    name ^= name >> np.uint64(33)
    count = np.bincount(owner, minlength=n).astype(float)
    bags = np.bincount(owner * HASHED + (name % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    same = np.concatenate([[False], (name[1:] == name[:-1])])
    two = np.concatenate([[False, False], name[2:] == name[:-2]])[:len(name)]
    distinct = _distinct(owner, name)
    length = (stop - start).astype(float)
    mean = np.bincount(owner, length, n) / count
    extra = np.stack([np.bincount(owner, same, n) / count, np.bincount(owner, two, n) / count,
                      np.bincount(distinct, minlength=n) / count, mean / 10,
                      np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / count - mean ** 2, 0)) / 10,
                      np.log1p(count) / 5], axis=1)
    return np.concatenate([chars / size, bags / count[:, None], extra], axis=1).astype(np.float32)


def _distinct(owner: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Owners of the distinct (owner, name) pairs."""
    order = np.lexsort((name, owner))
    o, w = owner[order], name[order]
    return o[np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])])]


class AttentionModel:
    """Gated attention over passages; weights are plain arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda a, b: r.normal(0, 1 / math.sqrt(a), (a, b))
        self.p = {"W": g(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, HIDDEN), "U": g(HIDDEN, HIDDEN),
                  "w": g(HIDDEN, 1)[:, 0], "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.constant: float | None = 0.5

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return h, t, s, a, z, y, sizes

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the bags of passages that begin at ``starts``."""
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self._forward(self._scaled(x), starts)[5]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> "AttentionModel":
        """Adam on the documents' log loss, with weight decay."""
        if not len(bags):
            return self
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), np.sqrt(everything.var(0) + 1e-6)
        self.constant = None
        bags = [self._scaled(b) for b in bags]
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * 0.5 * (1 + math.cos(math.pi * epoch / epochs)) + 1e-4
            order = r.permutation(len(bags))
            for at in range(0, len(order), 128):
                pick = order[at:at + 128]
                x = np.concatenate([bags[i] for i in pick])
                starts = np.cumsum([0, *[len(bags[i]) for i in pick[:-1]]])
                grads = self._gradients(x, starts, labels[pick])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a, z, out, sizes = self._forward(x, starts)
        dy = (out - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"][None, :], sizes, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de,
                "c": z.T @ dy, "d": np.array([dy.sum()])}


def drawn_passages(x: np.ndarray, most: int = SAMPLE_PASSAGES) -> np.ndarray:
    """At most ``most`` of the passages, those whose numbers have the smallest hashes."""
    if len(x) <= most:
        return x
    mixed = np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return x[np.sort(np.argsort(mixed * np.uint64(0xD6E8FEB86659FD93), kind="stable")[:most])]


def fit(docs: DataFrame, labels: DataFrame, learn_from, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> AttentionModel:
    """Model of ``labels`` (``id_col``, ``label_col``) learned from documents
    for which the Column ``learn_from`` (over the id) holds.

    ``sample`` labelled ids with the smallest hashes are drawn, their texts
    are encoded by the executors, and the bounded set of passage vectors is
    fitted on the driver.
    """
    drawn = labels.filter(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [drawn_passages(passages(t.as_py())).astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())],
                                             ["id", "label", "x"])
    one = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")) \
        .join(F.broadcast(drawn), F.col("doc") == F.col("_id")) \
        .select(F.col("_id").cast("string").alias("id"), F.col("_label").cast("double").alias("label"), "text")
    rows = one.mapInArrow(lean(encode), "id string, label double, x binary") \
        .groupBy("id").agg(F.max("label").alias("label"), F.min("x").alias("x")).collect()  # at most ``sample`` rows
    rows.sort(key=lambda r: r["id"])
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    return AttentionModel().fit(bags, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and, as the last column, the probability of label 1 of the whole
    text: ``score_col``, with underscores added where the input has that name."""
    while score_col in docs.columns:
        score_col += "_"
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(it, at):
            out: list[np.ndarray] = []
            bags: list[np.ndarray] = []
            held = 0

            def flush():
                if bags:
                    out.append(model.score(np.concatenate(bags).astype(np.float64), np.cumsum([0, *map(len, bags[:-1])])))
                    bags.clear()
            for text in batch.column(at):
                bags.append(passages(text.as_py()))
                held += len(bags[-1])
                if held > 4000:
                    flush()
                    held = 0
            flush()
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, score_col])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{fields}, `{score_col}` double")
