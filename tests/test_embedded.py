"""Embedded variants read in batches, on one shuffle of the lines."""

import json

from pyspark.sql import functions as F

from shelfline.functions.text import keep_one
from shelfline.operators.embedded import cents, number, variants_of
from shelfline.operators.structured import with_embedded, with_jsonld
from shelfline.plans import QUERIES, load_all, standins


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, folder):
    spark.range(3).selectExpr("id AS p_partkey", "'red blue' AS p_name", "9.5D AS p_retailprice").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(o, p, s, s % 2 + 1, "N") for o in range(2) for p in (0, 1, 2, None) for s in (1, 2, 3)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string") \
        .write.parquet(f"{folder}/lineitem.parquet")


def test_variants_are_not_read_by_expressions(spark):
    df = spark.createDataFrame([(1, [json.dumps([{"sku": "a", "price": 1e22}])])], "k int, variant_texts array<string>")
    out = with_embedded(df)
    assert _plan(out).count("variant_get") == 0
    v = out.first().embedded[0]  # such a price ended the job
    assert (v.sku, v.price.final, v.images, v.options) == ("a", "100000000000000000000.00", [], None)


def test_no_variants_and_half_surrogates(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "[]", "x"]), (4, ["[null]", '[{"sku": "\\ud800"}]'])], "k int, variant_texts array<string>")
    assert {r.k: r.embedded and [v.sku for v in r.embedded] for r in with_embedded(df).collect()} == {1: None, 2: None, 3: None, 4: ["?"]}


def test_shared_values_are_read_once_for_all_variants():
    doc = {"product": {"options": [{"name": "SIZE"}, 7, {"name": [1, None]}], "images": [{"id": 1, "url": "u"}, {"id": "1", "src": "s"}, {"id": 2}],
                       "variants": [{"id": 5, "image_id": "1", "option1": "S", "option3": True}, None, 3, {"image_id": 2}, {"image_id": 9}]}}
    assert variants_of([None, "{", json.dumps(doc)]) == [
        ("5", "", "", "u", None, None, [("size", "S"), ("1,", "true")]), ("", "", "", None, None, None, []),
        ("", "", "", "", None, None, []), ("", "", "", None, None, None, [])]
    assert variants_of(['{"variants": [{"a": 1, "a": 2}]}', "[NaN]", '[{"id": 1}] more'])[0][0] == "1"


def test_numbers_as_javascript_writes_them():
    assert [number(x) for x in (0.0, -3.0, 2.50, 1e-6, 1.5e-7, 1e21, 0.1, 123456789012345680000.0)] == [
        "0", "-3", "2.5", "0.000001", "1.5e-7", "1e+21", "0.1", "123456789012345680000"]
    assert [cents(x) for x in (None, "1", True, 100.5, -150.5, -0.2, 1999.0)] == [None, "1", "true", "1.00", "-1.50", "0.00", "19.99"]


def test_pages_without_jsonld_are_not_worked_on(spark):
    df = spark.createDataFrame([(1, ["null"]), (2, []), (3, None), (4, ['{"@type": "Product", "name": "a"}'])], "k int, scripts array<string>")
    out = with_jsonld(df)
    assert {r.k: r.jsonld and r.jsonld.name for r in out.collect()} == {1: None, 2: None, 3: None, 4: "a"}
    assert _plan(out).count("if (isnotnull(_node") >= 6


def test_pages_come_from_one_shuffle_of_the_lines(spark, tmp_path, monkeypatch):
    load_all()
    _tables(spark, tmp_path)
    monkeypatch.setattr(standins, "LINES_A_TASK", 5)
    pages = standins.shopify_pages(spark, str(tmp_path))
    assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert pages.rdd.getNumPartitions() >= 4
    got = QUERIES["embedded_variants"](spark, str(tmp_path)).collect()
    assert sorted((r.sku, r.variant_sku) for r in got) == [(str(p), f"P-{p}-S-{s}") for p in (1, 2) for s in (1, 2, 3)]


def test_keys_of_several_columns(spark):
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n")) for n, (a, b) in enumerate(
        [("x", "1"), ("x1", ""), (None, "1"), ("x", "1"), (None, "1"), ("x", None)])])
    got = spark.range(1).select(keep_one(items, lambda x: (x["a"], x["b"])).alias("f"), keep_one(items, lambda x: (x["a"], x["b"]), True).alias("l")).first()
    assert [x.n for x in got.f] == [0, 1, 2, 5] and [x.n for x in got.l] == [1, 3, 4, 5]
