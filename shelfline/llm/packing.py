"""Vector bin packing of tokenized documents into training sequences.

A piece is a vector of three demands: tokens, segments (one) and
loss-bearing tokens.  A sequence has a capacity for each.  Sequences are
filled one after the other; the next piece is the one with the largest dot
product of its demand and what is left of the sequence (both as shares of the
capacity), among those that fit.  Documents may be cut anywhere, so a
sequence that no whole piece fits is topped up with the head of one, and a
last sequence that cannot be filled is closed at a power of two, which needs
no padding.

Every task packs its own documents in pools of ``pool`` pieces, so nothing is
shuffled and memory is bounded by the pool (a waiting piece holds its own ids,
not its document's), the words remembered and an output batch; a task ends with at most
``log2(max_tokens)`` short sequences.  Rows depend only on the task's input
rows, so a repeated task gives the same sequences.

Defined results: null and empty texts are one end token; null ids are kept;
repeated rows are packed as often as they come; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean, release_memory

MAX_TOKENS = 4096
MAX_SEGMENTS = 128
END_ID = 2
POOL = 2048
#: Words a worker remembers in each of two generations.
CACHE_WORDS = 300_000
#: Bytes of the texts whose words are looked up at once (one text may have more).
BATCH_BYTES = 2 << 20
#: Bytes of ids of the documents in one output batch (one document may have more).
FRAME_BYTES = 4 << 20


class _Words(dict):
    """Remembered words; one that is not here is asked for (``ask``)."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        return self.ask(word)


class _Letters(dict):
    """Pieces of letters by code point, for ``str.translate``; of a letter with
    none or several: U+0000, which is in no piece of letters."""

    def __init__(self, pieces):
        self.pieces = pieces

    def __missing__(self, code: int) -> str:
        found = self.pieces(chr(code))
        self[code] = found[0] if len(found) == 1 else "\0"
        return self[code]


class WordTokenizer:
    """Token ids of whole texts by a ``tokenizers`` file that never joins
    words over ASCII white space: each word is tokenized once and remembered."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.packed = [struct.pack("<I", k) for k in range(self.tok.get_vocab_size())]
        self.young: dict[bytes, bytes] = _Words(self._known)
        self.old: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        pieces = lambda s: [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(s))]
        self.pieces = pieces
        self.letters = _Letters(pieces)
        if self.ids("Two words") != self.ids("Two") + self.ids("words"):
            raise ValueError("the tokenizer joins words over white space")
        # what the fast ways below take for granted, asked of the tokenizer itself
        self.lower = pieces("QwErTy") == ["qwerty"]
        self.ascii_words = self.lower and pieces("abz") == ["abz"]
        self.tail = {m.encode() for m in ".,;:" if pieces("ab" + m) == ["ab", m]}
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _word(self, word: bytes) -> bytes:
        if self.ascii_words and word.isalpha():  # of bytes: ASCII letters only
            return self._tokens(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if word[-1:] in self.tail and text[:-1].isalpha():
            return self.young[word[:-1]] + self.young[word[-1:]]
        if self.ascii_words and text.isalpha() and max(text) < "\u0300":
            # letters without combining forms: the piece is the pieces of the letters
            letters = text.translate(self.letters)
            if "\0" not in letters:
                return self._tokens(letters)
        if any(s in word for s in self.special):
            return self._bytes(self.ids(text))
        return self._bytes([t.id for p in self.pieces(text) for t in self.tokenize(p)])

    def _tokens(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(piece)])

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[k] for k in ids])

    def _known(self, word: bytes) -> bytes:
        """Of a word that is not in ``young``, where it is put."""
        got = self.old.get(word)
        if got is None:
            got = self._word(word)
        young = self.young
        if len(young) >= self.cache_words:  # the same dict goes on: a text may be in the middle of it
            self.old.clear()
            self.old.update(young)
            young.clear()
        if len(word) <= 64:
            young[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text; a word is looked up once for all of them."""
        texts = pc.fill_null(texts, "")
        if self.lower and not any(pc.any(pc.match_substring(texts, s[:2].decode())).as_py() for s in self.special):
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)  # leaves empty words at the ends of a text
        words = lists.flatten().dictionary_encode()
        known = pa.array(map(self.young.__getitem__, words.dictionary.cast(pa.binary()).to_pylist()), pa.large_binary())
        _, ends, data = known.take(words.indices).buffers()
        cuts = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist() if data else [0] * (len(texts) + 1)
        return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(cuts, cuts[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Sequences of one task: ``add`` pieces, ``rows`` come out sequence by sequence."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int):
        self.caps = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.sequence = first_sequence
        self.pool: list[tuple] = []  # (payload, start, tokens, loss-bearing)

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for payload, start, length, _ in pieces:
            yield payload, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def add(self, payload, tokens: int, loss: bool = True) -> Iterator[tuple]:
        """A document's tokens; whole sequences of it leave at once."""
        full = min(self.max_tokens, self.max_loss) if loss else self.max_tokens
        start = 0
        while tokens - start >= full and full == self.max_tokens:
            yield from self._emit([(payload, start, full, loss)])
            start += full
        while start < tokens:
            length = min(tokens - start, full)
            self.pool.append((payload, start, length, loss))
            start += length

    def drain(self, keep: int = 0) -> Iterator[tuple]:
        """Pack the pool until at most ``keep`` pieces are left."""
        if len(self.pool) <= keep:
            return
        demand = np.array([(t, 1, t if loss else 0) for _, _, t, loss in self.pool], float)
        share = demand / self.caps
        free = np.ones(len(demand), bool)
        left = len(demand)
        while left > keep:
            bin_, room, used = [], self.caps.copy(), 0
            while left and used < self.max_tokens and room[1] >= 1:
                # a slot is left, so only tokens and loss decide
                fits = free & (demand[:, 0] <= room[0]) & (demand[:, 2] <= room[2])
                score = np.where(fits, share @ (room / self.caps), -1.0)
                best = int(score.argmax())
                last_slot = room[1] < 2
                if score[best] < 0 or last_slot and demand[best, 0] < room[0]:
                    # no whole piece fits, or the last slot would stay short: the head of the longest one
                    able = np.where(free, np.where(demand[:, 2] > 0, np.minimum(demand[:, 0], room[2]), demand[:, 0]), 0)
                    best = int(able.argmax())
                    take = int(min(able[best], room[0]))
                    if take <= 0:
                        break
                else:
                    take = int(demand[best, 0])
                payload, start, length, loss = self.pool[best]
                bin_.append((payload, start, take, loss))
                used += take
                room -= (take, 1, take if loss else 0)
                if take == length:
                    free[best] = False
                    left -= 1
                else:
                    self.pool[best] = (payload, start + take, length - take, loss)
                    demand[best] = (length - take, 1, length - take if loss else 0)
                    share[best] = demand[best] / self.caps
            if used < self.max_tokens:  # close at a power of two; what is cut off goes back
                spare = used - (1 << (used.bit_length() - 1))
                while spare:
                    payload, start, length, loss = bin_.pop()
                    back = min(length, spare)
                    spare -= back
                    if length > back:
                        bin_.append((payload, start, length - back, loss))
                    self.pool.append((payload, start + length - back, back, loss))
                    demand = np.vstack([demand, (back, 1, back if loss else 0)])
                    share = np.vstack([share, demand[-1] / self.caps])
                    free = np.append(free, True)
                    left += 1
            yield from self._emit(bin_)
        self.pool = [p for p, f in zip(self.pool, free) if f]


_ROW = [("start", "bigint"), ("length", "bigint"), ("ids", "binary"), ("doc_tokens", "bigint"),
        ("sequence_id", "bigint"), ("offset", "bigint")]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None,
         end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Pieces ``doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset``.  ``loss_col`` (boolean) tells whether a
    row's tokens bear loss; without it all do."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    max_loss = max_loss or max_tokens
    loss = F.coalesce(F.col(loss_col), F.lit(False)) if loss_col else F.lit(True)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[n for n, _ in _ROW]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 33)

        def frame(out: list[tuple], id_type) -> pa.RecordBatch:
            cols = [[p[0][0] for p in out], [p[1] for p in out], [p[2] for p in out],
                    [p[0][1][4 * (p[1] - p[0][3]):4 * (p[1] + p[2] - p[0][3])] for p in out], [p[0][2] for p in out],
                    [p[3] for p in out], [p[4] for p in out]]
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        release_memory()  # of earlier stages: a worker is used again and keeps what they freed
        id_type = None
        out: list[tuple] = []
        held = 0
        for batch in by_bytes(it, 1, BATCH_BYTES):
            id_type = batch.schema.field(0).type
            for doc_id, ids, bears in zip(batch.column(0), tok.encode_all(batch.column(1)), batch.column(2)):
                ids += end
                held += len(ids)
                waiting, doc, n = len(packer.pool), doc_id.as_py(), len(ids) // 4
                out.extend(packer.add((doc, ids, n, 0), n, bears.as_py()))
                for k in range(waiting, len(packer.pool)):  # a piece waits without the rest of its document
                    _, start, length, marked = packer.pool[k]
                    packer.pool[k] = ((doc, ids[4 * start:4 * (start + length)], n, start), start, length, marked)
                if len(packer.pool) >= pool:
                    out.extend(packer.drain(keep=pool // 4))
                if len(out) >= 2000 or held > FRAME_BYTES:
                    if out:
                        yield frame(out, id_type)
                    out, held = [], 0
        out.extend(packer.drain())
        if out:
            yield frame(out, id_type)
    return rows.mapInArrow(lean(run), f"doc_id {kind}, " + ", ".join(f"`{n}` {t}" for n, t in _ROW))
