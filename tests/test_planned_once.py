"""Large expressions are evaluated once a row, in enough tasks."""

import pytest
from pyspark.sql import functions as F

from shelfline.functions.text import first_and_last, let
from shelfline.operators.transform import top_level_options
from shelfline.plans import QUERIES, load_all, standins
from shelfline.plans.page_crawl import crawl_pages


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, folder, parts=4):
    spark.range(parts).selectExpr("cast(id AS int) AS p_partkey", "'red blue' AS p_name", "'B' AS p_brand", "1 AS p_size",
                                  "9.5D AS p_retailprice", "'T' AS p_type").coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, 1, s, s % 2 + 1, "N") for s in range(4)],
                          "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")


def test_a_filter_on_the_status_does_not_copy_extraction_and_transform(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", "<h1>X</h1>")], "page_id long, url string, html string")
    out = crawl_pages(pages).filter("status = 'crawled'").select("page_id", "product")
    assert _plan(out).count("Unknown availability value") == 1
    assert [r.product.name for r in out.collect()] == ["X"]


@pytest.mark.parametrize("query", ["api_simple", "api_complex"])
def test_products_are_transformed_once(spark, tmp_path, query):
    load_all()
    _tables(spark, tmp_path)
    out = QUERIES[query](spark, str(tmp_path))
    assert _plan(out).count("Unknown availability value") == 1
    assert out.count() == 4


@pytest.mark.parametrize("query", ["product_options", "flat_options"])
def test_options_are_grouped_once(spark, tmp_path, query):
    load_all()
    _tables(spark, tmp_path)
    out = QUERIES[query](spark, str(tmp_path))
    assert _plan(out).count("flatten(") <= (1 if query == "product_options" else 2)  # the other flattens image rows
    assert {(r.option_id, r.value, r.uid) for r in out.collect()} == {
        ("size", "1", "S0" if query == "product_options" else "S2"), ("size", "2", "S1" if query == "product_options" else "S3"),
        ("color", "red", "C0" if query == "product_options" else "C3")}


def test_options_of_many_variants(spark):
    options = F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda i: F.struct(F.array(F.struct(
        F.when(i % 2 == 0, F.lit("")).otherwise(F.lit("w-d")).alias("id"), F.concat(F.lit("v "), (i % 3000).cast("string")).alias("value"),
        F.when(i > 10, i.cast("string")).otherwise(F.lit("")).alias("uid"))).alias("options")))
    got = spark.range(1).select(let(options, top_level_options).alias("o")).first().o
    assert len(got) == 1501
    wd = next(o for o in got if o.id == "w-d")
    assert (wd.label, wd.position, len(wd["values"])) == ("W D", 2, 1500)
    assert [(v.value, v.uid) for v in wd["values"][:7]] == [(f"v {i}", str(i) if i > 10 else None) for i in range(1, 14, 2)]


def test_first_and_last_keeps_the_order_of_the_first(spark):
    got = spark.range(1).select(first_and_last(F.array(*map(F.lit, ["b1", "a1", "b2", "c1", "a2"])), lambda x: F.left(x, F.lit(1))).alias("o"))
    assert [tuple(r) for r in got.first().o] == [("b1", "b2"), ("a1", "a2"), ("c1", "c1")]


def test_parts_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path, 25)
    monkeypatch.setattr(standins, "PARTS_A_TASK", 10)
    for build in (standins.jsonld_pages, standins.mixed_pages, standins.troubled_pages, standins.shop_pages, standins.api_simple_views):
        rows = build(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 3
        assert rows.count() == 25 + (5 if build is standins.shop_pages else 0)
