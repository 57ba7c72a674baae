"""Language identification with bit-sliced Bloom filters of character n-grams.

For each language the n-grams (of lower-cased letters, with word ends) that
make up at least ``MIN_SHARE`` of its n-grams are put in a Bloom filter.  The
filters are bit-sliced: slot ``i`` of one table holds a bitmask with the bit
of every language whose filter has bit ``i`` set, so the AND of an n-gram's
``HASHES`` slots gives *all* languages that contain it.  A text's languages
are counted by popcounts of these masks; a language's count is corrected for
the share of foreign n-grams that its filter passes falsely, and the largest
corrected share decides.

At most ``1 / MIN_SHARE`` n-grams of a language reach the share, which bounds
the filters (``SLOTS`` words of 64 languages each) at any corpus size; they
are the only data broadcast.  Counting n-grams adds up per task before it
shuffles.  Scoring reads each text once, without a shuffle.

Defined results: null text and text without a letter is ``und`` with score 0;
so is every text if nothing can be learned; on ties the smaller language
name; rows with a null id or language are not learned from; repeated rows
count as often as they come; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAM = 4
MIN_SHARE = 2e-5
SLOTS = 1 << 20
HASHES = 3
UND = "und"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_POW = [np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(8)]
_letter = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """Which code points are letters (made once a process)."""
    if not _letter[65]:
        _letter[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _letter


def gram_hashes(text: str | None, size: int = GRAM) -> np.ndarray:
    """Hashes of the n-grams of letters; every run of other characters is one boundary."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[code]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    code = np.where(is_letter, code, 0)
    code = code[is_letter | np.concatenate([[True], is_letter[:-1]])]  # one 0 after each word
    code = np.concatenate([[0], code, [0]] if code[0] else [code, [0]]).astype(np.uint64)
    if code[-2] == 0:
        code = code[:-1]
    size = min(size, len(code))
    n = len(code) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += code[k:k + n] * _POW[size - k] + _POW[k]
    h ^= h >> np.uint64(29)
    return h * _MIX[0]


def _slots(h: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    return [((h * _MIX[k]) >> np.uint64(40)).astype(np.int64) % slots for k in range(HASHES)]


class MaskFilters:
    """Bit-sliced filters: ``tables[p][slot]`` has the bits of languages 64p to 64p + 63."""

    def __init__(self, grams: dict[str, np.ndarray], slots: int = SLOTS):
        self.langs = sorted(grams)
        self.slots = slots
        planes = -(-len(self.langs) // 64)
        self.tables = np.zeros((planes, slots), np.uint64)
        for i, lang in enumerate(self.langs):
            for s in _slots(grams[lang], slots):
                self.tables[i // 64, s] |= np.uint64(1) << np.uint64(i % 64)
        # an absent n-gram passes a filter with the share of set bits to the number of hashes
        self.false = np.array([float(np.mean((self.tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) ** HASHES
                               for i in range(len(self.langs))])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of all languages' corrected counts."""
        h = gram_hashes(text)
        if not len(h) or not self.langs:
            return UND, 0.0
        at = _slots(h, self.slots)
        counts = np.empty(len(self.langs))
        for p in range(len(self.tables)):
            masks = self.tables[p][at[0]]
            for s in at[1:]:
                masks = masks & self.tables[p][s]
            for i in range(64 * p, min(64 * p + 64, len(self.langs))):
                counts[i] = np.count_nonzero(masks & (np.uint64(1) << np.uint64(i % 64)))
        share = np.maximum((counts / len(h) - self.false) / np.maximum(1 - self.false, 1e-9), 0)
        best = int(share.argmax())
        total = share.sum()
        return self.langs[best], float(share[best] / total) if total > 0 else 0.0


def learn(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          min_share: float = MIN_SHARE, slots: int = SLOTS) -> MaskFilters:
    """Filters from all documents with a language for which ``learn_from`` holds."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = gram_hashes(text.as_py())
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > 8_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
    rows = docs.filter(learn_from & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    grams = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams, "grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most 1 / min_share n-grams of each language come to the driver
    often = grams.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * min_share) \
        .groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return MaskFilters({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in often}, slots)


def predict(docs: DataFrame, filters: MaskFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in it:
            out = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()),
                                              pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
