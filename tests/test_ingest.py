"""Resumed ingest through the whole page path."""

import pytest

from shelfline.plans import QUERIES, load_all
from shelfline.streaming.ingest import ingest_crawl


def _page(name):
    return f"<html><body><h1>{name}</h1></body></html>"


def test_second_run_adds_only_new_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(1, "https://a.com/x", _page("X")), (2, "https://a.com/y", _page("Y")), (3, "https://a.com/x", _page("other"))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    ingest_crawl(spark, source, schema, base)
    more = [(4, "https://a.com/y", _page("again")), (5, "https://a.com/z", _page("Z")), (6, "https://a.com/e", "<html></html>")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ingest_crawl(spark, source, schema, base)
    got = {(r.page_id, r.status, r.product.name if r.product else None) for r in spark.read.parquet(f"{base}/pages").collect()}
    assert got == {(1, "crawled", "X"), (2, "crawled", "Y"), (5, "crawled", "Z"), (6, "skipped", None)}


@pytest.mark.parametrize("query", ["ingest_crawl", "ingest_stream"])
@pytest.mark.parametrize("folder", [True, False])
def test_table_may_be_a_file_or_a_folder(spark, tmp_path, query, folder):
    load_all()
    rows = [(i, f"https://a.com/p{i}", _page(f"P{i}")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if folder:
        pages.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    spark.createDataFrame([(9, "https://a.com/no", "")], pages.schema).write.parquet(str(tmp_path / "other.parquet"))
    got = {(r.page_id, r.path) for r in QUERIES[query](spark, str(tmp_path)).collect()}
    assert got == {(i, f"/p{i}") for i in range(4)}
