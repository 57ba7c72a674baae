"""Chat formatting with schema fingerprints.

A record is a JSON object in one of many layouts.  Of the set of its nested
field paths (``messages[].role``) every mapping sees the paths that it names
itself; the hash of this view tells whether the mapping fits, and the first
mapping that fits says where turns, roles and texts are, whatever other fields
the record has.  All layouts become canonical turns, which a template then
marks::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside texts are escaped reversibly: a run of ``n``
backslashes between ``<`` and ``|`` becomes ``n + 1``, so an unescaped ``<|``
is always the template's own.  Roles also escape backslash and line feed.

Converting and formatting are row by row.  Only the digest of a whole
conversation needs its turns together, in order: it is folded over sorted rows
and keeps two hash states, so a conversation of any length fits in a task.

Defined results: null text is empty, null role is an empty role; turns are
ordered by turn (null last), place in the record, role, text; repeated rows
are turns of their own; null conversation ids form one conversation; text in
parts is its parts, a line each, parts that are not text as JSON; a record that
no mapping fits, or whose list of messages is empty, has no turns (``layout``
null in ``canonical_turns``) and is handed back by ``unmapped_records`` and
counted by ``unmapped_counts``, and so is one that is no JSON or nested deeper
than the JSON parser goes; a turn that is no 64-bit integer orders like a null
one; a half of a surrogate pair becomes U+FFFD; ids keep their type; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Layouts: paths that must be there, paths that may, and how turns are read.
#: ``each`` walks an array of messages; ``fixed`` lists (role, path) pairs; ``row`` is one turn a record.
#: Of several that fit the first counts: lists of messages hold whole conversations, a turn row one turn.
MAPPINGS = [
    {"name": "messages", "need": ["messages[].role", "messages[].content"], "may": ["system"],
     "fixed": [("system", "system")], "each": ("messages", "role", "content")},
    {"name": "conversations", "need": ["conversations[].from", "conversations[].value"], "may": ["system"],
     "fixed": [("system", "system")], "each": ("conversations", "from", "value")},
    {"name": "conversations_content", "need": ["conversations[].role", "conversations[].content"], "may": ["system"],
     "fixed": [("system", "system")], "each": ("conversations", "role", "content")},
    {"name": "messages_value", "need": ["messages[].from", "messages[].value"], "may": ["system"],
     "fixed": [("system", "system")], "each": ("messages", "from", "value")},
    {"name": "instruction", "need": ["instruction", "output"], "may": ["input", "system"],
     "fixed": [("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")]},
    {"name": "instruction_response", "need": ["instruction", "response"], "may": ["context", "input", "system"],
     "fixed": [("system", "system"), ("user", ("instruction", "context", "input")), ("assistant", "response")]},
    {"name": "prompt_response", "need": ["prompt", "response"], "may": ["system"],
     "fixed": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt_completion", "need": ["prompt", "completion"], "may": ["system"],
     "fixed": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    {"name": "question_answer", "need": ["question", "answer"], "may": ["context", "system"],
     "fixed": [("system", "system"), ("user", ("context", "question")), ("assistant", "answer")]},
    {"name": "turn_row", "need": ["role", "text"], "may": ["turn"], "row": ("role", "text", "turn")},
]
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; array elements are ``[]``."""
    found: set[str] = set()
    todo = [(value, at)]
    while todo:  # a list, not calls: a record may be nested to any depth
        v, here = todo.pop()
        inner = [(x, f"{here}.{k}" if here else k) for k, x in v.items()] if isinstance(v, dict) \
            else [(x, f"{here}[]") for x in v] if isinstance(v, list) else []
        if inner:
            todo += inner
        else:
            found.add(f"{here}[]" if isinstance(v, list) else here)
    return found


def fingerprint(found: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()


_HALF = re.compile("[\ud800-\udfff]")


_KNOWN = {p for m in MAPPINGS for p in [*m["need"], *m["may"]]}
_FITTING = [({*m["need"], *m["may"]}, {fingerprint({*m["need"], *some}) for n in range(len(m["may"]) + 1)
                                       for some in combinations(m["may"], n)}, m) for m in MAPPINGS]
#: Paths that hold a text in parts.
_PARTS = re.compile(r"^([^.\[]*(?:\[\]\.[^.\[]*)?)\[\](?:\..*)?$")


@lru_cache(maxsize=10_000)
def _mapping(known: frozenset[str]) -> tuple[str | None, dict | None]:
    """Fingerprint and mapping of the first mapping that fits paths of ``_KNOWN``."""
    for named, marks, m in _FITTING:
        mark = fingerprint(known & named)
        if mark in marks:
            return mark, m
    return None, None


def _say(v) -> str:
    if isinstance(v, list):
        parts = [p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else p for p in v]
        return "\n".join(_say(p) for p in parts if p is not None)
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def turns_of(record) -> tuple[str | None, str, list[tuple[int | None, str, str]]]:
    """(layout, fingerprint, turns as (order, role, text)) of one record; the
    fingerprint of a record without turns is that of all its paths."""
    found = paths(record) if isinstance(record, dict) else set()
    whole = {p[1] for p in map(_PARTS.match, found) if p}
    mark, m = _mapping(frozenset((found | whole) & _KNOWN))
    if m is None:
        return None, fingerprint(found), []
    name = lambda r: ROLES.get(_say(r).lower(), _say(r)) if "row" not in m else _say(r)
    out: list[tuple[int | None, str, str]] = []
    if "row" in m:
        role, text, order = m["row"]
        turn = record.get(order)
        fits = isinstance(turn, int) and not isinstance(turn, bool) and abs(turn) < 1 << 63
        return m["name"], mark, [(turn if fits else None, name(record[role]), _say(record[text]))]
    before = [(r, p) for r, p in m.get("fixed", [])]
    for role, where in before:
        texts = [_say(record.get(p)) for p in ((where,) if isinstance(where, str) else where)]
        text = "\n".join(t for t in texts if t) if len(texts) > 1 else texts[0]
        if text or role != "system":
            out.append((None, role, text))
    if "each" in m:
        array, role, text = m["each"]
        out += [(None, name(x.get(role)), _say(x.get(text))) if isinstance(x, dict) else (None, "", _say(x))
                for x in record[array] if x is not None]
    return m["name"], mark, out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def mark_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, start and length of its text in it (characters)."""
    head = START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, body = formatted[len(START):].split("\n", 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return unescape(role), unescape(body[:body.index(END)])


def _read(raw: str | None) -> tuple[str | None, str, list[tuple[int | None, str, str]]]:
    try:
        layout, mark, turns = turns_of(json.loads(raw) if raw is not None else None)
    except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
        return None, fingerprint(set()), []
    # a half of a surrogate pair is no character: it becomes U+FFFD
    return layout, mark, [(o, _HALF.sub("\ufffd", r), _HALF.sub("\ufffd", t)) for o, r, t in turns]


_TURN = pa.schema([("turn", pa.int64()), ("place", pa.int64()), ("layout", pa.string()), ("fingerprint", pa.string()),
                   ("role", pa.string()), ("text", pa.string())])


def _slices(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that lists made of them stay small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """``conv_id, turn, place, layout, fingerprint, role, text`` of JSON records; a
    record without a mapping gives one row whose ``layout`` is null."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            out: list[tuple] = []
            of: list[int] = []
            for at, raw in enumerate(batch.column(1).to_pylist()):
                layout, mark, turns = _read(raw)
                rows = [(o, k, layout, mark, r, t) for k, (o, r, t) in enumerate(turns)]
                if layout is None:
                    rows = [(None, 0, None, mark, None, None)]
                out += rows
                of += [at] * len(rows)
            cols = list(zip(*out)) if out else [[]] * len(_TURN)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())),
                                              *[pa.array(c, f.type) for c, f in zip(cols, _TURN)]], ["conv_id", *_TURN.names])
    return records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record")).mapInArrow(
        run, f"conv_id {kind}, turn bigint, place bigint, layout string, fingerprint string, role string, text string")


def unmapped_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """``conv_id, record, fingerprint``: the records that have no turns, as they are."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            read = [_read(raw) for raw in batch.column(1).to_pylist()]
            of = [at for at, (layout, _, _) in enumerate(read) if layout is None]
            some = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([read[at][1] for at in of], pa.string())], ["conv_id", "record", "fingerprint"])
    return records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record")) \
        .mapInArrow(run, f"conv_id {kind}, record string, fingerprint string")


def unmapped_counts(unmapped: DataFrame) -> DataFrame:
    """``fingerprint, n_records``: how many records of each layout have no turns."""
    return unmapped.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_records"))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, place, formatted, loss_start, loss_length``: a turn's part of the
    formatted conversation and the span in it that bears loss (assistant texts)."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it):
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            done = [mark_turn(r or "", t or "") for r, t in zip(roles, texts)]
            loss = [(s, n) if r == "assistant" else (None, 0) for r, (_, s, n) in zip(roles, done)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([d[0] for d in done], pa.string()),
                 pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                ["conv_id", "turn", "place", "formatted", "loss_start", "loss_length"])
    return turns.filter(F.col("layout").isNotNull()).select("conv_id", "turn", "place", "role", "text").mapInArrow(
        run, f"conv_id {kind}, turn bigint, place bigint, formatted string, loss_start bigint, loss_length bigint")


_DIGEST = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted turns."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = id_type = None
        rows: list[tuple] = []

        def close():
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def frame():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, f.type) for c, f in zip(columns[1:], _DIGEST)]],
                                              ["conv_id", *_DIGEST.names])
        for batch in it:
            id_type = batch.schema.field(0).type
            for conv, text, start, length in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    lossy = unescape(text[start:start + length])
                    state[3] += len(lossy)
                    state[4].update(lossy.encode())
                state[5] += len(text)
            if len(rows) > 5000:
                yield frame()
                rows.clear()
        if state is not None:
            close()
        if rows:
            yield frame()
    # equal role and text give equal formatted turns, and their order is the order of (role, text)
    order = ["conv_id", F.col("turn").asc_nulls_last(), "place", "_role", "_text"]
    head = F.split_part("formatted", F.lit("\n"), F.lit(1))
    sorted_ = formatted.withColumn("_role", head).withColumn("_text", F.substring(
        F.col("formatted"), F.length(head) + 1, F.length("formatted"))) \
        .repartition("conv_id").sortWithinPartitions(*order)
    return sorted_.select("conv_id", "turn", "place", "formatted", "loss_start", "loss_length").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
