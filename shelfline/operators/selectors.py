"""CSS selectors, parsed and matched against parsed elements.

Matching happens inside the tokenizer pass (``fields.py`` files the selectors of
a plan in one index), where the page is in memory already.

Supported subset (everything the configurations use): type selector or ``*``,
``#id``, ``.class`` (compound), ``[a]``, ``[a=v]``, ``[a*=v]``, ``[a^=v]``,
``[a$=v]``, ``[a~=v]``, ``[a|=v]``, descendant and child (``>``) combinators,
comma lists.
"""

from __future__ import annotations

import re
from functools import lru_cache

_TOKEN = re.compile(
    r"""(?P<comb>\s*>\s*)|(?P<ws>\s+)|(?P<tag>[a-zA-Z*][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|
        \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*
        (?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]""",
    re.X,
)
_ANY = (("any", None, None, None),)


@lru_cache(maxsize=None)
def parse_selector(selector: str) -> tuple:
    """``'div.a > p[x="1"]'`` -> ((None, comp), ('>', comp)); ``comp`` is a
    tuple of (kind, name, op, value) conditions."""
    s = selector.strip()
    parts, comp, comb, pos = [], [], None, 0
    while pos < len(s):
        m = _TOKEN.match(s, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector: {selector!r}")
        pos = m.end()
        g = m.groupdict()
        if g["comb"] is not None or g["ws"] is not None:
            parts.append((comb, tuple(comp) or _ANY))
            comp, comb = [], (">" if g["comb"] is not None else " ")
        elif g["tag"]:
            comp.append(("tag", g["tag"].lower(), None, None) if g["tag"] != "*" else _ANY[0])
        elif g["id"]:
            comp.append(("id", g["id"], None, None))
        elif g["cls"]:
            comp.append(("class", g["cls"], None, None))
        else:
            val = g["dq"] if g["dq"] is not None else g["sq"] if g["sq"] is not None else g["bare"]
            comp.append(("attr", g["attr"].lower(), g["op"], val))
    parts.append((comb, tuple(comp) or _ANY))
    return tuple(parts)


# --- matching (runs inside the E0 Arrow pass) --------------------------------

def _cond_ok(e: dict, attrs: dict, kind, name, op, value) -> bool:
    if kind == "any":
        return True
    if kind == "tag":
        return e["tag"] == name
    if kind == "id":
        return attrs.get("id") == name
    if kind == "class":
        return name in e["classes"]
    v = attrs.get(name)
    if v is None:
        return False
    if op is None:
        return True
    if op == "=":
        return v == value
    if op == "*=":
        return value != "" and value in v
    if op == "^=":
        return value != "" and v.startswith(value)
    if op == "$=":
        return value != "" and v.endswith(value)
    if op == "~=":
        return value in v.split()
    return v == value or v.startswith(value + "-")


def compound_ok(elems, i, comp) -> bool:
    e = elems[i]
    attrs = e["_amap"]
    return all(_cond_ok(e, attrs, *c) for c in comp)


def match_ancestors(elems, parts, k, i) -> bool:
    """parts[k] matched at element i; check parts[:k] against ancestors."""
    if k == 0:
        return True
    comb = parts[k][0]
    a = elems[i]["parent"]
    while a >= 0:
        if compound_ok(elems, a, parts[k - 1][1]) and match_ancestors(elems, parts, k - 1, a):
            return True
        if comb == ">":
            return False
        a = elems[a]["parent"]
    return False
