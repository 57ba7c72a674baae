"""E0 + E1 + E3 with field pushdown: HTML -> the few values a plan asks for.

A :class:`PageFields` names the values that are wanted of a page: fields (the
first of several sources that is not blank) and lists (attributes of all
matching elements).  They are sent into the tokenizer, so one ``mapInArrow``
stage returns narrow columns and no element leaves the Python worker.  Pages of
different shops are read by the same stage: every row names the rules it is
read with.

The selectors of all rules are one index (:class:`SelectorIndex`): each
selector is filed under the id, class, tag or attribute its last compound
needs, so an element is only tried against the selectors filed under what it
has.  Ancestors are prefiltered by a Bloom filter: every element carries the
bits of its ancestors' ids, classes and tags, and a selector whose ancestor
compounds need a bit that is missing is not walked.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .dom import BATCH_CHARS, parse_dom
from .selectors import compound_ok, match_ancestors, parse_selector

#: White space of JavaScript's ``trim``.
JS_SPACE = ("\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000\ufeff")
BLOOM_BITS = 256


@dataclass
class PageFields:
    """Values of a page.

    ``fields``: name -> sources ``(selector, take)`` in order of preference;
    ``take`` is ``text`` (textContent; ``text<n``: if shorter than n), ``html`` (inner HTML) or ``@name`` (an
    attribute).  Of a source the first matching element counts, and the first
    source that is not blank wins, trimmed.
    ``firsts``: name -> sources: what each source gives, untrimmed, null where
    nothing matches.
    ``lists``: name -> (selectors, takes): for every match of each selector in
    turn (document order) its takes, a struct if there are several.
    """
    fields: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    firsts: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    lists: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)

    def selectors(self) -> list[str]:
        found = [s for sources in (*self.fields.values(), *self.firsts.values()) for s, _ in sources]
        return list(dict.fromkeys(found + [s for selectors, _ in self.lists.values() for s in selectors]))


def _tokens(compound) -> list[str]:
    marks = {"id": "#", "class": ".", "tag": ""}
    return [marks[kind] + name for kind, name, _, _ in compound if kind in marks]


def _bit(token: str) -> int:
    return 1 << (zlib.crc32(token.encode()) % BLOOM_BITS)


class SelectorIndex:
    """Selectors filed by what their last compound needs."""

    def __init__(self, selectors: list[str]):
        self.selectors = selectors
        self.filed: dict[str, list[tuple[int, tuple, int]]] = {}
        for k, selector in enumerate(selectors):
            for one in selector.split(","):
                parts = parse_selector(one)
                last = parts[-1][1]
                tokens = sorted(_tokens(last), key=lambda t: "#.".find(t[0]) % 3)  # id, class, tag
                attrs = ["[" + name for kind, name, _, _ in last if kind == "attr"]
                need = 0
                for _, compound in parts[:-1]:
                    for t in _tokens(compound):
                        need |= _bit(t)
                self.filed.setdefault(next(iter([*tokens, *attrs]), "*"), []).append((k, parts, need))

    def match(self, elems: list[dict]) -> list[list[int]]:
        """For each selector the ids of its elements in document order."""
        hits: list[list[int]] = [[] for _ in self.selectors]
        filed, bits = self.filed, {}
        above: list[int] = []  # bits of each element and its ancestors

        def bit(token):
            if token not in bits:
                bits[token] = _bit(token)
            return bits[token]
        for i, e in enumerate(elems):
            attrs, parent = e["_amap"], e["parent"]
            keys = [e["tag"], *("." + c for c in e["classes"])]
            if e["id"]:
                keys.append("#" + e["id"])
            outer = above[parent] if parent >= 0 else 0
            own = outer
            for t in keys:
                own |= bit(t)
            above.append(own)
            for key in (*dict.fromkeys(keys), *("[" + a for a in attrs), "*"):
                for k, parts, need in filed.get(key, ()):
                    if need & ~outer or hits[k] and hits[k][-1] == i:
                        continue
                    if compound_ok(elems, i, parts[-1][1]) and match_ancestors(elems, parts, len(parts) - 1, i):
                        hits[k].append(i)
        return hits


def read_fields(html: str | None, rules: PageFields, index: SelectorIndex) -> dict | None:
    """The values of one page (``index`` over ``rules.selectors()``)."""
    page = parse_dom(html)
    if page is None:
        return None
    elems, texts = page["elements"], page["texts"]
    hits = dict(zip(index.selectors, index.match(elems)))

    def take(i: int, what: str) -> str | None:
        e = elems[i]
        if what[0] == "@":
            return e["_amap"].get(what[1:])
        if what == "html":
            return html[e["h0"]:e["h1"]]
        text = "".join(texts[e["t0"]:e["t1"]])
        return text if what == "text" or len(text) < int(what.removeprefix("text<")) else None

    def source(selector: str, what: str) -> str | None:
        return take(hits[selector][0], what) if hits[selector] else None
    out = {name: next(filter(None, ((source(*s) or "").strip(JS_SPACE) for s in sources)), None)
           for name, sources in rules.fields.items()}
    out |= {name: [source(*s) for s in sources] for name, sources in rules.firsts.items()}
    for name, (selectors, takes) in rules.lists.items():
        found = [tuple(take(i, t) for t in takes) for s in selectors for i in hits[s]]
        out[name] = found if len(takes) > 1 else [x for x, in found]
    return out


def list_type(takes: list[str]) -> T.ArrayType:
    """Strings, or structs with a string for each take (``@data-src`` -> ``data_src``)."""
    if len(takes) == 1:
        return T.ArrayType(T.StringType())
    return T.ArrayType(T.StructType([T.StructField(t.lstrip("@").replace("-", "_"), T.StringType()) for t in takes]))


def with_fields(pages: DataFrame, rules: dict[str, PageFields], rules_col: str | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with one column for each field and list
    of the rules (all ``rules`` name the same ones).  ``rules_col`` names each
    row's rules; without it the only ones are used.  Rows of unknown rules and
    of null HTML get nulls.  No shuffle; pages leave in batches of 4 MB."""
    from pyspark.sql.pandas.types import to_arrow_type
    some = next(iter(rules.values()))
    added = [*[T.StructField(n, T.StringType()) for n in some.fields],
             *[T.StructField(n, T.ArrayType(T.StringType())) for n in some.firsts],
             *[T.StructField(n, list_type(takes)) for n, (_, takes) in some.lists.items()]]
    types = [to_arrow_type(f.dataType) for f in added]
    kept = [f for f in pages.schema.fields if f.name != html_col]
    names = [*[f.name for f in kept], *[f.name for f in added]]
    if len(rules) > 1 and rules_col is None:
        raise ValueError("rules_col names the rules of a row")

    def run(batches):
        index = {k: SelectorIndex(r.selectors()) for k, r in rules.items()}
        only = next(iter(rules)) if rules_col is None else None
        for batch in batches:
            html = batch.column(batch.schema.get_field_index(html_col))
            which = batch.column(batch.schema.get_field_index(rules_col)).to_pylist() if rules_col else None
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            start, held, found = 0, 0, []
            for row in range(batch.num_rows):
                key = which[row] if which else only
                text = html[row].as_py()
                found.append(read_fields(text, rules[key], index[key]) if key in index else None)
                held += len(text or "")
                if held >= BATCH_CHARS or row + 1 == batch.num_rows:
                    columns = [pa.array([_value(r, f) for r in found], type=t) for f, t in zip(added, types)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(start, row + 1 - start) for c in rest], *columns], names)
                    start, held, found = row + 1, 0, []
    return pages.mapInArrow(run, T.StructType([*kept, *added]))


def _value(record: dict | None, f: T.StructField):
    value = record[f.name] if record else None
    if not value or not isinstance(value[0], tuple):
        return value
    keys = f.dataType.elementType.names
    return [dict(zip(keys, x)) for x in value]


def hrefs(pages: DataFrame, selectors: list[str], name: str, html_col: str = "html") -> DataFrame:
    """``pages`` with ``name``: the ``href`` of every element each selector matches in turn."""
    return with_fields(pages, {"": PageFields(lists={name: (selectors, ["@href"])})}, html_col=html_col)
