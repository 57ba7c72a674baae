"""Literal-row tests for the column functions."""

from pyspark.sql import functions as F

from shelfline.functions.enums import normalize_availability, normalize_condition
from shelfline.functions.prices import currency_from_symbol, parse_price
from shelfline.functions.text import word_capitalize
from shelfline.functions.urls import product_path, resolve_url, sku_from_url


def _col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn("x")).collect()]


def test_product_path(spark):
    got = _col(spark, ["https://store.com/products/Cool-Widget.html", "https://x.com/item%20one",
                       "https://x.com/a.html/", "https://x.com", "https://x.com/a/./b/../c",
                       "https://x.com/collections/spring-sale/products/blue-2024-poster", "https://x.com/a_b/C_d"],
               product_path)
    assert got == ["/products/cool-widget", "/item-20one", "/a-html", None, "/a/c",
                   "/collections/spring-sale/products/blue-2024-poster", "/a-b/c-d"]


def test_product_path_prefix(spark):
    assert _col(spark, ["https://x.com/p"], lambda c: product_path(c, "en_US")) == [None]
    assert _col(spark, ["https://x.com/p"], lambda c: product_path(c, "shop")) == ["/shop/p"]


def test_sku_from_url(spark):
    got = _col(spark, ["https://store.com/products/cool-widget", "https://x.com/", "https://x.com/a/b.c.html"],
               sku_from_url)
    assert got == ["COOL-WIDGET", "UNKNOWN", "B-C"]


def test_parse_price(spark):
    got = _col(spark, ["$1.299", "1.299,00 €", "$1,299.00", "99,99", "1299.00", ",5", "Free", "12"], parse_price)
    assert got == ["1299", "1299.00", "1299.00", "99.99", "1299.00", None, None, "12"]


def test_currency(spark):
    assert _col(spark, ["R$ 10", "10 kr", "10", "5 €", "CHF 3"], currency_from_symbol) == \
        ["USD", "SEK", None, "EUR", "CHF"]


def test_availability(spark):
    got = _col(spark, ["https://schema.org/InStock", "pre-order", "sold out", " In Stock ", "weird"],
               normalize_availability)
    assert got == ["InStock", "PreOrder", "SoldOut", "InStock", None]
    assert _col(spark, ["new", "http://schema.org/UsedCondition", "mint"], normalize_condition) == \
        ["NewCondition", "UsedCondition", None]


def test_word_capitalize(spark):
    got = _col(spark, ["color", "usb-cable", "it's_big"], lambda c: word_capitalize(F.regexp_replace(c, "[-_]", " ")))
    assert got == ["Color", "Usb Cable", "It'S Big"]


def test_resolve_url(spark):
    df = spark.createDataFrame([("/für", "http://a.com/x/y?q=1"), ("b/c", "http://a.com/x/y"),
                                ("//cdn.x/i.png", "https://a.com/")], "h string, b string")
    got = [r[0] for r in df.select(resolve_url("h", "b")).collect()]
    assert got == ["http://a.com/f%C3%BCr", "http://a.com/x/b/c", "https://cdn.x/i.png"]


def test_path_expressions_stay_small(spark):
    df = spark.createDataFrame([("x",)], "u string")
    for fn in (product_path, sku_from_url):
        plan = df.select(fn("u"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") < 40
