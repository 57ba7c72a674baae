"""Token counts by trie-shared dynamic programming.

A unigram model gives each piece a log probability; the tokens of a pre-token
are those of its best segmentation (largest sum; on ties fewest tokens).  The
best score of a prefix does not depend on what follows, so the distinct
pre-tokens of a task are inserted in a trie, the forward step is done once for
each new node, that is once for each shared prefix, and the node at which a
pre-token ends stores its token count.

Pieces come from a ``sentencepiece`` file.  If it is no unigram model, its
pieces are ranked by frequency (merge order) and get Zipf's probabilities:
``p`` proportional to ``1 / (rank + 1)``.  A character without a piece is
spelled with the byte pieces.

Texts are read once and nothing is shuffled; a task's trie is started anew
above ``max_nodes`` nodes, which changes no count.

Defined results: null and empty texts have no tokens; null ids are kept;
repeated rows are counted as often as they come; extra columns are ignored;
pre-tokens above ``LONG`` characters are scored without being kept; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONG = 64
MAX_NODES = 600_000
_NONE = object()


class Pieces:
    """Log probabilities of the pieces of a ``sentencepiece`` file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in normal]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        has_bytes = all(sp.is_byte(i) for i in self.bytes)
        if scores and min(scores) <= -1000:  # ranks of a merge order, not log probabilities
            order = sorted(range(len(normal)), key=lambda k: (-scores[k], k))
            total = math.log(sum(1 / (r + 1) for r in range(len(order))))
            scores = [0.0] * len(normal)
            for r, k in enumerate(order):
                scores[k] = -math.log(r + 1) - total
        self.score = {sp.id_to_piece(i): s for i, s in zip(normal, scores)}
        self.longest = max(map(len, self.score), default=1)
        #: Every suffix of a piece; the score where the suffix is a piece itself.
        self.suffix = {p[k:]: self.score.get(p[k:]) for p in self.score for k in range(len(p))}
        #: Each byte of a character without a piece: below any piece.
        self.byte_score = min(scores, default=0.0) - 10.0 if has_bytes else -100.0


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


class TokenTrie:
    """Trie of pre-tokens with the forward score and count of every prefix."""

    def __init__(self, model: Pieces, max_nodes: int = MAX_NODES):
        self.model, self.max_nodes = model, max_nodes
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def _step(self, text: str, end: int, path: list[int]) -> tuple[float, int]:
        """Best (score, tokens) of ``text[:end]``; ``path``: nodes of the shorter prefixes."""
        suffix, score, count = self.model.suffix, self.score, self.count
        best, tokens = -math.inf, 0
        for start in range(end - 1, -1, -1):
            s = suffix.get(text[start:end], _NONE)
            n = 1
            if s is None or s is _NONE:
                if start == end - 1:
                    n = len(text[start].encode())
                    s = n * self.model.byte_score
                elif s is None:  # the end of a longer piece only
                    continue
                else:  # no piece ends like this, nor like anything longer
                    break
            at = path[start]
            s += score[at]
            n += count[at]
            if s > best or s == best and n < tokens:
                best, tokens = s, n
        return best, tokens

    def tokens(self, word: str) -> int:
        """Token count of a pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        text = SPACE + word
        if len(text) > LONG:
            return self._long(text)
        if len(self.score) > self.max_nodes:
            self.clear()
        node, path = 0, [0]
        for end in range(1, len(text) + 1):
            child = self.children[node].get(text[end - 1])
            if child is None:
                best, tokens = self._step(text, end, path)
                child = len(self.score)
                self.children[node][text[end - 1]] = child
                self.children.append({})
                self.score.append(best)
                self.count.append(tokens)
            node = child
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def _long(self, text: str) -> int:
        """Forward scores of one long pre-token in a window of the longest piece."""
        scores, counts = [0.0], [0]
        wide = self.model.longest
        for end in range(1, len(text) + 1):
            best, tokens = -math.inf, 0
            for size in range(1, min(end, wide) + 1):
                s, n = self.model.score.get(text[end - size:end]), 1
                if s is None:
                    if size > 1:
                        continue
                    n = len(text[end - 1].encode())
                    s = n * self.model.byte_score
                s, n = s + scores[-size], n + counts[-size]
                if s > best or s == best and n < tokens:
                    best, tokens = s, n
            scores.append(best)
            counts.append(tokens)
            if len(scores) > 4 * wide:
                del scores[:-wide], counts[:-wide]
        return counts[-1]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(pieces(model_path), max_nodes)
        for batch in it:
            n_words = np.zeros(batch.num_rows, np.int64)
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(1)):
                words = [w.decode() for w in (text.as_py() or "").encode().split()]
                known = list(map(trie.terminal.get, words))
                if None in known:
                    known = [trie.tokens(w) if n is None else n for w, n in zip(words, known)]
                n_words[k], n_tokens[k] = len(words), sum(known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)],
                                             ["doc_id", "n_words", "n_tokens"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
