"""E4-E13 schema.org products and E21-E22 embedded variant JSON, as columns.

E0 leaves the texts of a page's JSON-LD scripts (and of its embedded variant
JSON) as string arrays.  JSON-LD is parsed to VARIANT and read by SQL
expressions, in stages: product node, offers and variants, product.  Between
stages a one-row ``explode`` keeps the optimiser from merging the projections,
so each stage is planned on its own; rows never leave their page and nothing
shuffles.  Embedded variants are read by ``embedded`` in Python.

Scalars follow JavaScript: ``truthy`` is its test, ``text`` its ``String()``.
Expressions are built as SQL text; ``bind`` names a value that is used more
than once, so no sub-expression is copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..schemas import IMAGE, OPTION, PRICE, RATING, VARIANT
from .embedded import VARIANTS, read_batches

# --- fixed values ------------------------------------------------------------
GTIN_KEYS = ["gtin", "gtin13", "gtin12", "gtin8", "gtin14"]
LIST_PRICE_TYPES = ["ListPrice", "MSRP"]
DIRECT_OPTION_KEYS = ["color", "size", "material", "pattern", "width", "height"]
SCHEMA_ORG_PREFIXES = ["https://schema.org/", "http://schema.org/"]
# White space of JavaScript's trim().
JS_SPACES = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
# -----------------------------------------------------------------------------

_names = count()


def bind(value: str, body) -> str:
    """``body(name)`` with ``name`` bound to ``value``."""
    name = f"b{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def at(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def items(v: str) -> str:
    """Elements of an array, or the value itself as the only one."""
    return f"coalesce(try_variant_get({v}, '$', 'array<variant>'), array({v}))"


def _kind(x: str) -> str:
    return f"left(schema_of_variant({x}), 3)"


def _number(x: str) -> str:
    plain = lambda d: f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM cast(cast({d} AS decimal(38, 16)) AS string)))"
    return bind(f"try_variant_get({x}, '$', 'double')", lambda d: (
        f"CASE WHEN {d} = 0 THEN '0' WHEN abs({d}) < 1e21 AND abs({d}) >= 1e-6 THEN {plain(d)} "
        f"ELSE replace(replace(lower(cast({d} AS string)), '.0e', 'e'), 'e', CASE WHEN abs({d}) >= 1 THEN 'e+' ELSE 'e' END) END"))


def _scalar(x: str, k: str) -> str:
    return (f"CASE WHEN {k} IN ('STR', 'BOO') THEN try_variant_get({x}, '$', 'string') WHEN {k} = 'OBJ' THEN '[object Object]' "
            f"WHEN {k} = 'VOI' THEN NULL ELSE {_number(x)} END")


def text(v: str) -> str:
    """``String(v)``; NULL for null and missing."""
    inner = lambda y: bind(_kind(y), lambda k: f"coalesce({_scalar(y, k)}, '')")
    return bind(v, lambda x: bind(_kind(x), lambda k: (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {k} = 'ARR' THEN "
        f"array_join(transform(try_variant_get({x}, '$', 'array<variant>'), e -> {inner('e')}), ',') ELSE {_scalar(x, k)} END")))


def truthy(v: str) -> str:
    """``v`` itself if it is true in a test, else NULL."""
    return bind(v, lambda x: bind(_kind(x), lambda k: (
        f"CASE WHEN {x} IS NULL OR {k} = 'VOI' THEN NULL WHEN {k} IN ('OBJ', 'ARR') THEN {x} "
        f"WHEN {k} = 'STR' THEN if(try_variant_get({x}, '$', 'string') <> '', {x}, NULL) "
        f"WHEN {k} = 'BOO' THEN if(try_variant_get({x}, '$', 'boolean'), {x}, NULL) "
        f"ELSE if(coalesce(try_variant_get({x}, '$', 'double'), 0) <> 0, {x}, NULL) END")))


def told(v: str) -> str:
    """Text of a truthy value, else NULL."""
    return text(truthy(v))


def trimmed(s: str) -> str:
    return f"trim(BOTH '{JS_SPACES}' FROM {s})"


def bare(v: str) -> str:
    """Enumeration value without its schema.org prefix (first occurrence)."""
    cut = lambda s, p: bind(s, lambda x: (
        f"if(instr({x}, '{p}') > 0, concat(left({x}, instr({x}, '{p}') - 1), "
        f"substring({x}, instr({x}, '{p}') + {len(p)})), {x})"))
    out = told(v)
    for prefix in SCHEMA_ORG_PREFIXES:
        out = cut(out, prefix)
    return out


def struct(kind, **fields: str) -> str:
    """A struct of ``kind``'s fields in their order; fields not given are NULL."""
    inner = ", ".join(f"'{f.name}', {fields.get(f.name, 'NULL')}" for f in kind.fields)
    return f"cast(named_struct({inner}) AS {kind.simpleString()})"


def _array(kind) -> str:
    return f"cast(array() AS array<{kind.simpleString()}>)"


def images(v: str) -> str:
    """Strings and image objects; anything else is left out."""
    def one(x):
        label = f"coalesce({told(at(x, 'caption'))}, {told(at(x, 'name'))})"
        pick = bind(told(at(x, "url")), lambda u: (
            f"CASE WHEN {u} IS NOT NULL THEN {struct(IMAGE, url=u, label=label)} ELSE "
            + bind(told(f"try_variant_get({x}, '$[\"@id\"]', 'variant')"),
                   lambda i: f"if({i} IS NULL, NULL, {struct(IMAGE, url=i)})") + " END"))
        plain = struct(IMAGE, url=f"try_variant_get({x}, '$', 'string')")
        return bind(_kind(x), lambda k: f"CASE WHEN {k} = 'STR' THEN {plain} WHEN {k} = 'OBJ' THEN {pick} END")
    return bind(truthy(v), lambda x: (f"if({x} IS NULL, {_array(IMAGE)}, filter(transform({items(x)}, i -> {one('i')}), "
                                      f"i -> i IS NOT NULL))"))


def _price(currency: str, final: str, regular: str = "NULL") -> str:
    return bind(f"named_struct('c', {currency}, 'r', {regular}, 'f', {final})", lambda p: (
        f"if(coalesce({p}.c, {p}.r, {p}.f) IS NULL, NULL, {struct(PRICE, currency=f'{p}.c', regular=f'{p}.r', final=f'{p}.f')})"))


def offer(x: str) -> str:
    """One offer; list prices come from its price specifications (the last one counts)."""
    kinds = ", ".join(f"'{k}'" for k in LIST_PRICE_TYPES)

    def priced(specs):
        listed = f"filter({specs}, s -> try_variant_get(s, '$.priceType', 'string') IN ({kinds}))"
        regular = bind(f"try_element_at({listed}, -1)",
                       lambda s: f"if({s} IS NULL, NULL, coalesce({text(at(s, 'price'))}, "
                                 f"if(is_variant_null({at(s, 'price')}), 'null', 'undefined')))")
        currency = (f"coalesce({told(at(x, 'priceCurrency'))}, "
                    f"get(filter(transform({specs}, s -> {told(at('s', 'priceCurrency'))}), c -> c IS NOT NULL), 0))")
        return _price(currency, text(at(x, "price")), regular)
    specs = bind(truthy(at(x, "priceSpecification")), lambda s: f"if({s} IS NULL, cast(array() AS array<variant>), {items(s)})")
    return (f"named_struct('sku', {told(at(x, 'sku'))}, 'name', {told(at(x, 'name'))}, 'url', {told(at(x, 'url'))}, "
            f"'price', {bind(specs, priced)}, 'availability', {bare(at(x, 'availability'))}, "
            f"'itemCondition', {bare(at(x, 'itemCondition'))}, 'images', {images(at(x, 'image'))})")


def offer_items(v: str) -> str:
    """The offers of an ``offers`` field in its four forms, as an array."""
    none = "cast(array() AS array<variant>)"

    def children(o):
        type_ = f"try_variant_get({o}, '$[\"@type\"]', 'string')"
        return bind(truthy(at(o, "offers")), lambda inner: (
            f"CASE WHEN {o} IS NULL THEN {none} WHEN {type_} = 'AggregateOffer' AND {inner} IS NOT NULL THEN {items(inner)} "
            f"WHEN {type_} = 'Offer' THEN array({o}) WHEN {_kind(o)} = 'ARR' THEN {items(o)} "
            f"WHEN {text(at(o, 'price'))} IS NOT NULL OR {told(at(o, 'priceCurrency'))} IS NOT NULL THEN array({o}) ELSE {none} END"))
    return bind(truthy(v), children)


def options(v: str) -> str:
    """Options from additional properties, else from the direct fields."""
    given = bind(truthy(at(v, "additionalProperty")), lambda a: (
        f"if({a} IS NULL, {_array(OPTION)}, filter(transform({items(a)}, p -> "
        + struct(OPTION, id=bind(told(at("p", "name")), lambda n: f"regexp_replace(lower({n}), '[{JS_SPACES}]+', '-')"),
                 value=text(at("p", "value"))) + "), p -> p.id IS NOT NULL AND p.value IS NOT NULL))"))
    direct = "array(" + ", ".join(struct(OPTION, id=f"'{k}'", value=told(at(v, k))) for k in DIRECT_OPTION_KEYS) + ")"
    return bind(given, lambda g: f"if(size({g}) > 0, {g}, " + bind(
        f"filter({direct}, d -> d.value IS NOT NULL)", lambda d: f"if(size({d}) > 0, {d}, NULL)") + ")")


def _is_product(x: str) -> str:
    type_ = "$[\"@type\"]"
    return (f"coalesce(array_contains(try_variant_get({x}, '{type_}', 'array<string>'), 'Product'), "
            f"contains(nullif(regexp_replace(try_variant_get({x}, '{type_}', 'string'), '^[{{].*$', ''), ''), 'Product'), false)")


def product_node(scripts: str) -> str:
    """The first product of the scripts, in document order.  Arrays are
    opened as deep as the text nests them; ``@graph`` is searched one level,
    and a null in it before any product gives none for the page."""
    opened = ("aggregate(sequence(1, regexp_count(t, '[\\\\[,](?=\\\\s*\\\\[)') + 1), array(try_parse_json(t)), "
              f"(acc, i) -> flatten(transform(acc, x -> {items('x')})))")
    graph = "coalesce(try_variant_get(x, '$[\"@graph\"]', 'array<variant>'), cast(array() AS array<variant>))"
    found = (f"flatten(transform(flatten(transform({scripts}, t -> {opened})), x -> CASE WHEN x IS NULL OR is_variant_null(x) "
             f"THEN cast(array() AS array<variant>) WHEN {_is_product('x')} THEN array(x) "
             f"ELSE filter({graph}, g -> g IS NULL OR is_variant_null(g) OR {_is_product('g')}) END))")
    return bind(f"get({found}, 0)", lambda n: f"if(is_variant_null({n}), NULL, {n})")


def _staged(df: DataFrame, given: str = "true", **columns: str) -> DataFrame:
    """Add columns behind a generator, which the optimiser does not merge; they
    are NULL, and not worked out, where ``given`` is not true."""
    packed = ", ".join(f"'{k}', {v}" for k, v in columns.items())
    return df.select("*", F.explode(F.expr(f"array(if({given}, named_struct({packed}), NULL))")).alias("_s")) \
        .select("*", *[F.col(f"_s.{k}").alias(k) for k in columns]).drop("_s")


def with_jsonld(df: DataFrame, scripts: str = "scripts", out: str = "jsonld") -> DataFrame:
    """Adds the raw product ``out`` (NULL without one); drops ``scripts``."""
    df = _staged(df, f"size({scripts}) > 0", _node=product_node(scripts)).drop(scripts)
    there = "_node IS NOT NULL"
    entries = bind(truthy(at("_node", "hasVariant")), lambda h: f"if({h} IS NULL, cast(array() AS array<variant>), {items(h)})")
    df = _staged(df, there, _offered=offer_items(at("_node", "offers")), _entries=entries, _images=images(at("_node", "image")),
                 _name=trimmed(told(at("_node", "name"))))
    df = _staged(df, there, _offers=f"transform(_offered, o -> {offer('o')})",
                 _firsts=f"transform(_entries, v -> get({offer_items(at('v', 'offers'))}, 0))")
    # One entry of hasVariant, by part; position joins the parts
    ids = ", ".join(trimmed(told(at("v", k))) for k in ("sku", "productID", "identifier"))
    df = _staged(df, there, _entry_offer=f"transform(_firsts, o -> {offer('o')})", _entry_text=(
        f"transform(_entries, v -> named_struct('sku', coalesce({ids}, ''), 'name', coalesce({trimmed(told(at('v', 'name')))}, ''), "
        f"'url', {trimmed(told(at('v', 'url')))}, 'availability', {bare(at('v', 'availability'))}))"))
    df = _staged(df, there, _entry_images=f"transform(_entries, v -> {images(at('v', 'image'))})",
                 _entry_options=f"transform(_entries, v -> {options('v')})",
                 _entry_price=f"transform(_entries, v -> {_price(told(at('v', 'priceCurrency')), text(at('v', 'price')))})")
    models = "transform(_entry_text, (t, i) -> " + struct(
        VARIANT, sku="t.sku", name="t.name", url="coalesce(t.url, get(_entry_offer, i).url, '')",
        images="if(size(get(_entry_images, i)) > 0, get(_entry_images, i), _images)",
        price="coalesce(get(_entry_offer, i).price, get(_entry_price, i))",
        availability="coalesce(get(_entry_offer, i).availability, t.availability)", options="get(_entry_options, i)") + ")"
    sold = "transform(_offers, o -> " + struct(
        VARIANT, sku="coalesce(o.sku, '')", name="coalesce(o.name, _name, '')", url="coalesce(o.url, '')",
        images="if(size(o.images) > 0, o.images, _images)", price="o.price", availability="o.availability") + ")"
    df = _staged(df, there, _models=models, _sold=f"if(size(_offers) > 1, {sold}, NULL)")
    rating = bind(truthy(at("_node", "aggregateRating")), lambda r: f"if({r} IS NULL, NULL, " + struct(
        RATING, ratingValue=text(at(r, "ratingValue")), bestRating=text(at(r, "bestRating")), worstRating=text(at(r, "worstRating")),
        reviewCount=f"coalesce({told(at(r, 'reviewCount'))}, {text(at(r, 'ratingCount'))}, {text(at(r, 'reviewCount'))})") + ")")
    brand = bind(truthy(at("_node", "brand")), lambda b: (
        f"if({_kind(b)} IN ('OBJ', 'ARR'), {told(at(b, 'name'))}, {text(b)})"))
    variants = ("CASE WHEN size(_models) > 0 AND _sold IS NOT NULL THEN concat(_sold, filter(_models, m -> "
                "NOT array_contains(transform(_sold, s -> s.sku), m.sku))) WHEN size(_models) > 0 THEN _models ELSE _sold END")
    one = "get(_offers, 0)"
    fields = {
        "name": "_name", "sku": f"coalesce({trimmed(told(at('_node', 'sku')))}, if(size(_offers) = 1, {one}.sku, NULL))",
        "url": trimmed(told(at("_node", "url"))), "description": trimmed(told(at("_node", "description"))), "brand": brand,
        "gtin": "coalesce(" + ", ".join(told(at("_node", k)) for k in GTIN_KEYS) + ")", "metaTitle": "cast(NULL AS string)",
        "metaDescription": "cast(NULL AS string)", "availability": f"coalesce({one}.availability, get(_models, 0).availability)",
        "itemCondition": f"{one}.itemCondition", "price": f"coalesce({one}.price, get(_models, 0).price)", "images": "_images",
        "aggregateRating": rating, "variants": variants}
    packed = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    df = _staged(df, **{out: f"if({there}, named_struct({packed}), NULL)"})
    return df.drop("_node", "_offered", "_offers", "_entries", "_firsts", "_entry_offer", "_entry_text", "_entry_images",
                   "_entry_options", "_entry_price", "_models", "_images", "_name", "_sold")


def with_embedded(df: DataFrame, texts: str = "variant_texts", out: str = "embedded") -> DataFrame:
    """Adds the variants ``out`` of the first text that has any, all of
    them; drops ``texts``.  They are read in Arrow batches (``embedded``): the
    texts go to Python and the variants come back, no other column does."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(VARIANTS)

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return read_batches(batches, kind)
    return df.select("*", once(F.arrow_udf(read, VARIANTS)(F.col(texts))).alias(out)).drop(texts)
