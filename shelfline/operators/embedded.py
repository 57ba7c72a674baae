"""E21-E22 embedded variant JSON: texts -> product variants, in Arrow batches.

A page has one document and up to hundreds of variants with a dozen values
each.  The document is parsed once to plain Python values (every number a
double, as in JavaScript), what all variants share (option names, images by
id) is read once, and the variants of a batch are returned as flat columns.

Scalars follow JavaScript, as in ``structured``: ``told`` is the ``String()`` of
a value that is true in a test.
"""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import types as T

from ..schemas import VARIANT
from .dom import BATCH_CHARS

VARIANTS = T.ArrayType(VARIANT)

_DECIMALS = Context(prec=60, rounding=ROUND_HALF_UP)
_PLACES = Decimal(1).scaleb(-16)


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key comes twice")
    return out


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(object_pairs_hook=_unique, parse_int=float, parse_constant=_refuse)


def parse(text: str | None):
    """The first JSON value of a text; None if it is broken."""
    if text is None:
        return None
    try:
        return _decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\n\r")))[0]
    except (ValueError, RecursionError):
        return None


def number(d: float) -> str:
    size = abs(d)
    if d == 0:
        return "0"
    if size < 1e15 and d == int(d):
        return str(int(d))
    if size == float("inf"):
        return "infinity" if d > 0 else "-infinity"
    if 1e-6 <= size < 1e21:
        return format(_DECIMALS.quantize(Decimal(repr(d)), _PLACES), "f").rstrip("0").rstrip(".")
    mantissa, power = repr(d).split("e")
    return f"{mantissa}e{'+' if size >= 1 else ''}{int(power)}"


def _scalar(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    return "[object Object]" if isinstance(x, dict) else number(x)


def text(x) -> str | None:
    """``String(x)``; None for null and missing."""
    if x is None:
        return None
    if isinstance(x, list):
        return ",".join("" if e is None or isinstance(e, list) else _scalar(e) for e in x)
    return _scalar(x)


def truthy(x):
    """``x`` itself if it is true in a test, else None."""
    return x if x or isinstance(x, (dict, list)) else None


def told(x) -> str | None:
    """Text of a truthy value, else None."""
    return (x or None) if isinstance(x, str) else text(truthy(x))


def _at(x, *path):
    for k in path:
        if isinstance(k, int):
            x = x[k] if isinstance(x, list) and k < len(x) else None
        else:
            x = x.get(k) if isinstance(x, dict) else None
    return x


def cents(x) -> str | None:
    """Hundredths of a number with two decimals, as ``(n / 100).toFixed(2)``: the
    quotient is a double, and its exact value decides at the half."""
    if not isinstance(x, float):
        return text(x)
    if abs(x) >= 1e23 or x != x:  # toFixed has no decimals from 1e21 on
        return number(x / 100)
    over, under = (x / 100).as_integer_ratio()
    k = (200 * over + under) // (2 * under)
    return f"{'-' if k < 0 else ''}{abs(k) // 100}.{abs(k) % 100:02d}"


def _product(document) -> tuple:
    """The product of a document and its variants (may be empty)."""
    product = truthy(_at(document, "product"))
    product = document if product is None else product
    listed = truthy(_at(product, "variants"))
    listed = document if listed is None else listed
    return product, [v for v in listed if v is not None] if isinstance(listed, list) else []


def variants_of(texts: list[str | None] | None) -> list[tuple] | None:
    """Variants ``(sku, name, url, image URL, price, availability, options)`` of
    the first text that has any; a price is (final, regular), an option (id, value)."""
    for t in texts or ():
        product, listed = _product(parse(t))
        if not listed:
            continue
        names = [(told(_at(product, "options", k, "name")) or "").lower() or f"option{k + 1}" for k in range(3)]
        images, sources = {}, _at(product, "images")
        for i in sources if isinstance(sources, list) else ():
            key = text(_at(i, "id"))
            if key is not None and key not in images:
                src = told(_at(i, "src"))
                images[key] = (told(_at(i, "url")) or "") if src is None else src
        return [_variant(v if isinstance(v, dict) else {}, names, images) for v in listed]
    return None


def _first(v: dict, *keys: str) -> str:
    return next((x for x in (told(v.get(k)) for k in keys) if x is not None), "")


def _variant(v: dict, names: list[str], images: dict[str, str]) -> tuple:
    """One variant of an embedded product."""
    image = told(_at(v, "featured_image", "src"))
    if image is None and truthy(v.get("image_id")) is not None:
        image = images.get(text(v["image_id"]))
    price = v.get("price")
    if price is not None:
        price = cents(price), cents(truthy(v.get("compare_at_price")))
    available = v.get("available")
    options = [(name, x) for name, x in zip(names, (told(v.get(f"option{k}")) for k in (1, 2, 3))) if x is not None]
    return (_first(v, "sku", "id"), _first(v, "title", "name"), _first(v, "url"), image, price,
            ("InStock" if available else "OutOfStock") if isinstance(available, bool) else None, options)


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair
        return pa.array([x and x.encode("utf-8", "replace").decode() for x in values], pa.string())


def _list(kind: pa.DataType, sizes: list[int], values: pa.Array, nulls: list[bool] | None = None) -> pa.Array:
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    mask = pa.array(nulls, pa.bool_()) if nulls else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=mask)


def _struct(kind: pa.DataType, nulls: list[bool] | None = None, **columns: pa.Array) -> pa.Array:
    """A struct of ``kind``'s fields; those not given are null."""
    n = len(next(iter(columns.values())))
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in kind]
    return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array(nulls, pa.bool_()) if nulls else None)


def variant_array(rows: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    """The rows of ``variants_of`` as one array of ``kind`` (``VARIANTS``)."""
    flat = [v for row in rows for v in row or ()]
    skus, names, urls, images, prices, stocks, options = map(list, zip(*flat)) if flat else ([],) * 7
    one = {f.name: f.type for f in kind.value_type}
    shown = [o for row in options for o in row]
    variants = _struct(
        kind.value_type, sku=_strings(skus), name=_strings(names), url=_strings(urls),
        images=_list(one["images"], [int(u is not None) for u in images],
                     _struct(one["images"].value_type, url=_strings([u for u in images if u is not None]))),
        price=_struct(one["price"], [p is None for p in prices], final=_strings([p and p[0] for p in prices]),
                      regular=_strings([p and p[1] for p in prices])),
        availability=_strings(stocks),
        options=_list(one["options"], [len(o) for o in options],
                      _struct(one["options"].value_type, id=_strings([k for k, _ in shown]), value=_strings([x for _, x in shown])),
                      [not o for o in options]))
    return _list(kind, [len(r or ()) for r in rows], variants, [r is None for r in rows])


def read_batches(batches, kind: pa.DataType):
    """Arrays of texts -> arrays of variants, cut after every 4 MB of text."""
    for batch in batches:
        held, rows = 0, []
        for texts in batch:
            texts = texts.as_py()
            rows.append(variants_of(texts))
            held += sum(len(t or "") for t in texts or ())
            if held >= BATCH_CHARS:
                yield variant_array(rows, kind)
                held, rows = 0, []
        if rows or not len(batch):
            yield variant_array(rows, kind)
