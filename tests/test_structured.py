"""JSON-LD products (E4-E13) and embedded variants (E21-E22); all cases of a
kind are read by one plan."""

import json
from decimal import ROUND_HALF_UP, Decimal

import pytest

from shelfline.operators.structured import with_embedded, with_jsonld

SCALARS = {"49": 49.0, "100": 1e2, "19.99": 19.99, "true": True, "1,,a": [1, None, "a"], "[object Object]": {"a": 1},
           "1e+21": 1e21, "123456789.5": 123456789.5}
PRODUCTS = {
    "substring": [{"@type": "ProductGroup", "name": "a"}],
    "element": [{"@type": ["ProductGroup"], "name": "a"}],
    "elements": [{"@type": ["Thing", "Product"], "name": "a"}],
    "graph": [{"@graph": [{"@type": "Thing"}, {"@type": "Product", "name": "g"}]}],
    "deep": [[1, [[{"@type": "Product", "name": "deep"}]]]],
    "broken": ["not json", {"@type": "Product", "name": " x "}],
    "null in graph": [{"@graph": [None, {"@type": "Product", "name": "g"}]}, {"@type": "Product", "name": "later"}],
    "none": [],
    "merge": [{"@type": "Product", "name": "W", "offers": [{"sku": "A", "price": 49.00, "priceCurrency": "usd"}, {"sku": "B", "price": "5"}],
               "hasVariant": [{"sku": "B"}, {"sku": "C"}, {"sku": "C"}]}],
    "list price": [{"@type": "Product", "name": "W", "brand": {"name": "B"}, "gtin12": 12,
                    "image": ["a", {"url": "b", "name": "n"}, {"@id": "c"}, 5],
                    "offers": {"@type": "Offer", "price": 10, "availability": "https://schema.org/InStock", "priceSpecification": [
                        {"priceType": "ListPrice", "price": 12, "priceCurrency": "EUR"}, {"priceType": "MSRP", "price": 15}]},
                    "aggregateRating": {"ratingValue": 4.5, "reviewCount": 0, "ratingCount": 7}}],
    "aggregate": [{"@type": "Product", "sku": "P", "image": "i", "offers": {"@type": "AggregateOffer", "offers": [{"sku": "x", "price": 0}]},
                   "hasVariant": {"productID": 7, "offers": {"price": "3", "url": "u"}, "color": "red", "size": "L",
                                  "additionalProperty": [{"name": "Shoe  Size", "value": 9}, {"name": "", "value": 1}]}}],
    "direct": [{"@type": "Product", "hasVariant": [{"color": "red", "size": 4}]}],
    **{f"scalar {want}": [{"@type": "Product", "sku": value}] for want, value in SCALARS.items()},
}
CENTS = {100.5: "1.00", 0: "0.00", 5: "0.05", 12345: "123.45", 99.5: "0.99", 250.5: "2.50", 1.5: "0.01", 2.5: "0.03", 100.6: "1.01"}
EMBEDDED = {
    "shop": [None, "oops", {"product": {"options": [{"name": "Size"}], "images": [{"id": 5, "src": "s"}], "variants": [
        {"id": 7, "title": "S", "price": 1999, "compare_at_price": "25.00", "available": False, "option1": "S", "option2": "x", "image_id": 5}, None]}}],
    "many": [{"variants": [{"sku": str(i), "price": 1} for i in range(250)]}],
    "none": [None, {"variants": []}],
    **{f"cents {c}": [{"variants": [{"price": c}]}] for c in CENTS},
}


def _texts(blocks):
    return [b if isinstance(b, str) or b is None else json.dumps(b) for b in blocks]


@pytest.fixture(scope="module")
def products(spark):
    df = spark.createDataFrame([(k, _texts(v)) for k, v in PRODUCTS.items()], "k string, scripts array<string>")
    return {r.k: r.jsonld.asDict(recursive=True) if r.jsonld else None for r in with_jsonld(df).collect()}


@pytest.fixture(scope="module")
def embedded(spark):
    df = spark.createDataFrame([(k, _texts(v)) for k, v in EMBEDDED.items()], "k string, variant_texts array<string>")
    return {r.k: [x.asDict(recursive=True) for x in r.embedded] if r.embedded else None for r in with_embedded(df).collect()}


def test_which_node_is_the_product(products):
    names = {k: products[k] and products[k]["name"] for k in ("substring", "element", "elements", "graph", "deep", "broken", "null in graph", "none")}
    assert names == {"substring": "a", "element": None, "elements": "a", "graph": "g", "deep": "deep", "broken": "x",
                     "null in graph": None, "none": None}


def test_offers_and_has_variant_merge(products):
    p = products["merge"]
    assert [v["sku"] for v in p["variants"]] == ["A", "B", "C", "C"]
    assert p["price"] == {"currency": "usd", "regular": None, "final": "49"}


def test_list_price_rating_and_prefixes(products):
    p = products["list price"]
    assert p["price"] == {"currency": "EUR", "regular": "15", "final": "10"} and p["availability"] == "InStock"
    assert p["aggregateRating"]["reviewCount"] == "7" and p["aggregateRating"]["ratingValue"] == "4.5"
    assert p["brand"] == "B" and p["gtin"] == "12" and [(i["url"], i["label"]) for i in p["images"]] == [("a", None), ("b", "n"), ("c", None)]


def test_aggregate_offer_and_options(products):
    p = products["aggregate"]
    assert p["sku"] == "P" and p["price"]["final"] == "0"
    v = p["variants"][0]
    assert (v["sku"], v["url"], v["price"]["final"], v["images"][0]["url"]) == ("7", "u", "3", "i")
    assert [(o["id"], o["value"]) for o in v["options"]] == [("shoe-size", "9")]
    assert [(o["id"], o["value"]) for o in products["direct"]["variants"][0]["options"]] == [("color", "red"), ("size", "4")]


def test_javascript_strings(products):
    assert {k: products[f"scalar {k}"]["sku"] for k in SCALARS} == {k: k for k in SCALARS}


def test_embedded_variants(embedded):
    vs = embedded["shop"]
    assert vs[0]["price"] == {"currency": None, "regular": "25.00", "final": "19.99"}
    assert vs[0]["sku"] == "7" and vs[0]["availability"] == "OutOfStock" and vs[0]["images"][0]["url"] == "s" and len(vs) == 1
    assert [(o["id"], o["value"]) for o in vs[0]["options"]] == [("size", "S"), ("option2", "x")]
    assert len(embedded["many"]) == 250 and embedded["none"] is None


def test_cents_round_like_to_fixed(embedded):
    # the definition: the exact value of the double, halves up
    assert all(str(Decimal(c / 100).quantize(Decimal("0.01"), ROUND_HALF_UP)) == want for c, want in CENTS.items())
    assert {c: embedded[f"cents {c}"][0]["price"]["final"] for c in CENTS} == CENTS
