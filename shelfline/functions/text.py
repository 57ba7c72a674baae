"""String helpers with JavaScript string semantics, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters JavaScript's String.prototype.trim and \s treat as white space.
JS_WS = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """``String(x).trim()`` for a string column (NULL stays NULL)."""
    return F.regexp_replace(col_(c), f"^{JS_WS}+|{JS_WS}+$", "")


def blank_to_null(c) -> Column:
    """Empty string -> NULL (JS falsiness of strings)."""
    c = col_(c)
    return F.when(c != "", c)


def trimmed_or_null(c) -> Column:
    """``x?.trim() || null``."""
    return blank_to_null(js_trim(c))


def strip_html(c) -> Column:
    """Tags -> one space, white space runs -> one space, trimmed."""
    spaced = F.regexp_replace(col_(c), "<[^>]*>", " ")
    return js_trim(F.regexp_replace(spaced, f"{JS_WS}+", " "))


def replace_first(c, needle: str, repl: str = "") -> Column:
    """``String.prototype.replace`` with a string pattern: first occurrence only."""
    c = col_(c)
    pos = F.instr(c, needle)
    rest = F.substring(c, pos + len(needle), F.length(c))
    return F.when(pos > 0, F.concat(F.substring(c, F.lit(1), pos - 1), F.lit(repl), rest)).otherwise(c)


def word_capitalize(c) -> Column:
    """JS ``s.replace(/\\b\\w/g, u => u.toUpperCase())``: upper-case every ASCII
    letter that starts a word (previous char not in ``[A-Za-z0-9_]``); other
    letters keep their case."""
    def fixed(chars):
        return F.transform(
            chars,
            lambda ch, i: F.when(
                ch.rlike("^[a-z]$")
                & ((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("^[A-Za-z0-9_]$")),
                F.upper(ch),
            ).otherwise(ch),
        )
    return let(c, lambda x: F.when(x.isNotNull(), F.array_join(let(F.split(x, ""), fixed), "")))


def capitalize_first(c) -> Column:
    """``s.charAt(0).toUpperCase() + s.slice(1)``."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def let(value, body) -> Column:
    """Bind ``value`` once and use it in ``body(x)``: keeps expression trees
    linear when a large sub-expression is needed several times (Catalyst
    would otherwise copy it into every use)."""
    return F.get(F.transform(F.array(col_(value)), body), 0)


def once(value) -> Column:
    """``value`` in a one-row generator, for ``select``: filters and generators
    above it read the result; the optimiser would otherwise push them down with
    a copy of ``value`` each, and merge projections."""
    return F.explode(F.array(col_(value)))


def _tagged(items: Column, key, sign: int = 1) -> tuple[Column, Callable]:
    """``items`` as structs (keys, place ``i``, element ``x``) sorted by key and
    place, and a test of two of them for the same key.  Keys are fields of their
    own: comparing nested structs is several times slower."""
    def tag(x, i):
        keys = key(x)
        keys = keys if isinstance(keys, tuple) else (keys,)
        names.extend(f"k{n}" for n in range(len(names), len(keys)))
        return F.struct(*[k.alias(name) for k, name in zip(keys, names)], (i * sign).alias("i"), x.alias("x"))
    names: list[str] = []
    tagged = F.sort_array(F.transform(items, tag))
    return tagged, lambda a, b: reduce(and_, [a[name].eqNullSafe(b[name]) for name in names])


def first_and_last(items: Column, key) -> Column:
    """A struct (``first``, ``last``) of elements for each ``key(element)`` (a
    column or a tuple of them), in the order of the first ones.  Sorted by key
    and place, so the work grows with n log n, not with the square of the list."""
    tagged, same = _tagged(items, key)

    def ends(t):
        first = F.filter(t, lambda x, i: (i == 0) | ~same(F.get(t, i - 1), x))
        last = F.filter(t, lambda x, i: (i == F.size(t) - 1) | ~same(F.get(t, i + 1), x))
        return F.zip_with(first, last, lambda a, b: F.struct(a["i"].alias("i"), a["x"].alias("first"), b["x"].alias("last")))
    return F.transform(F.sort_array(let(tagged, ends)), lambda x: F.struct(x["first"], x["last"]))


def keep_one(items: Column, key, last: bool = False) -> Column:
    """``items`` with one element for each ``key(element)`` (a column or a tuple
    of them), the first (or ``last``), in the order of the elements kept.  Sorted
    by key and place, so the work grows with n log n, not with the square of the list."""
    sign = -1 if last else 1
    tagged, same = _tagged(items, key, sign)
    kept = let(tagged, lambda t: F.filter(t, lambda x, i: (i == 0) | ~same(F.get(t, i - 1), x)))
    placed = F.sort_array(F.transform(kept, lambda x: F.struct((x["i"] * sign).alias("i"), x["x"].alias("x"))))
    return F.transform(placed, lambda x: x["x"])
