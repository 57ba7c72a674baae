"""Literal-row tests of rules found wrong before: types, ties, caps, blanks."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfline.operators import state as R
from shelfline.operators.discovery import traverse
from shelfline.operators.enrich import related_ring
from shelfline.operators.flat import assemble_products, flat_rows, read_csv, write_csv
from shelfline.operators.validate import dry_run_report, validate_raw
from shelfline.schemas import PRODUCT
from shelfline.sources.products import scan_products
from shelfline.sources.sitemaps import parse_sitemaps, resolve

GOOD = {"sku": "S", "name": "N", "path": "/a/b"}


def _errors(spark, *records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "t string").select(F.try_parse_json("t").alias("raw"))
    return [r[0] for r in df.select(validate_raw()).collect()]


def test_every_type_rule(spark):
    got = _errors(
        spark, GOOD, GOOD | {"price": {"final": 12.5}, "metadata": {"k": 3}, "description": 5}, {"sku": 1, "name": "", "path": "x y"}, 5, None,
        GOOD | {"price": None, "images": {}, "variants": "v", "availability": "soon", "itemCondition": 1, "aggregateRating": {"ratingValue": 4}},
        GOOD | {"images": [{"url": 1}, {}], "variants": [{"sku": "a", "name": "b", "url": "c", "images": []}, {"sku": 1, "images": "x"}], "metadata": {"a": None}})
    assert got[0] == [] and got[3] == got[4] == ["product must be an object"]
    assert got[1] == ["description must be a string", "price.final must be a string", "metadata.k must be a string"]
    assert got[2] == ["sku is required and must be a string", "name is required and must be a string", 'path "x y" does not match required pattern']
    assert [e.split(" must")[0] for e in got[5]] == ["price", "availability", "itemCondition", "images", "variants", "aggregateRating.ratingValue"]
    assert got[6] == ["images[0].url is required and must be a string", "images[1].url is required and must be a string",
                      "variants[1].sku is required", "variants[1].name is required", "variants[1].url is required",
                      "variants[1].images is required and must be an array", "metadata.a must be a string"]


def test_pretty_printed_product_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=1))
    (tmp_path / "b.json").write_text("{oops")
    summary, reasons = dry_run_report(scan_products(spark, str(tmp_path), one_per_file=True))
    assert tuple(summary.first()) == (2, 1, 1) and "Unexpected token" in reasons.first()["reason"]


def test_percentages_round_half_up(spark):
    rows = [(f"u{i}", "crawled" if i < 49 else "pending", None, None, i) for i in range(400)]
    state = spark.createDataFrame(rows, "url string, status string, error string, crawled_at timestamp, ordinal long")
    assert R.stats(state).first()["crawled_pct"] == "12.3%"


def test_existing_keys_stay_and_pending(spark):
    state = spark.createDataFrame([("a", "crawled", None, None, 1)], "url string, status string, error string, crawled_at timestamp, ordinal int")
    out = R.upsert_frontier(state, spark.createDataFrame([("a", 5), ("b", 6), ("b", 7)], "url string, ordinal int"))
    assert {(r.url, r.status, r.ordinal) for r in out.collect()} == {("a", "crawled", 1), ("b", "pending", 6)}
    assert [r.url for r in R.pending(out).collect()] == ["b"]


def test_delivery_stops_at_an_authorisation_failure(spark):
    plan = R.batch_plan(spark.createDataFrame([(f"s{i:03d}", f"/p{i // 2:03d}") for i in range(200)], "sku string, path string"), "path", "sku")
    out = spark.createDataFrame([(0, 200), (1, 500), (2, 401), (3, 200)], "batch long, status_code int")
    assert [r.sku for r in plan.filter("batch = 0").orderBy("pos").collect()] == [f"s{i:03d}" for i in range(50)]
    s = R.delivery_summary(plan, out).first()
    assert (s.counted, s.uploaded, s.failed, s.first_failed_batch) == (150, 50, 100, 1)
    assert R.failed_skus(plan, out).count() == 100 and [r.batch for r in R.delivery_errors(plan, out).collect()] == [1, 2]


def test_ring_of_large_and_small_classes(spark):
    rows = [(f"/a{i}", "a") for i in range(40)] + [("/b0", "b"), ("/b1", "b"), ("/c", "c")]
    got = {}
    for r in related_ring(spark.createDataFrame(rows, "path string, class string")).collect():
        got.setdefault(r.path, []).append(r.related)
    cls = dict(rows)
    assert set(got) == set(cls) and all(len(v) == len(set(v)) == 5 and k not in v for k, v in got.items())
    assert all(cls[x] == "a" for k, v in got.items() if cls[k] == "a" for x in v)
    assert "/b1" in got["/b0"] and "/b0" in got["/b1"]
    assert related_ring(spark.createDataFrame(rows[:3], "path string, class string")).count() == 6


def test_long_and_circular_listings(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(300)] + [("x", "y"), ("y", "x"), ("s", "s"), ("m", "gone")]
    df = spark.createDataFrame(edges, "url string, next string")
    known = spark.createDataFrame([(u,) for u in {u for e in edges for u in e} - {"gone"}], "url string")
    starts = spark.createDataFrame([("A", "p0"), ("B", "x"), ("C", "s"), ("D", "m")], "origin string, url string")
    got = {}
    for r in traverse(starts, df, known).orderBy("step").collect():
        got.setdefault(r.origin, []).append((r.step, r.url))
    assert got["A"] == [(i + 1, f"p{i}") for i in range(301)]
    assert got["B"] == [(1, "x"), (2, "y")] and got["C"] == [(1, "s")] and got["D"] == [(1, "m")]


def test_deep_and_circular_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    docs = [(f"d{i}", index(f"d{i + 1}", "d0")) for i in range(6)] + [("d6", "<urlset><url><loc> u </loc></url></urlset>"), ("bad", "<x")]
    parsed = parse_sitemaps(spark.createDataFrame(docs, "url string, xml string"))
    got = resolve(spark.createDataFrame([("o", "d0", 0), ("o", "bad", 1)], "origin string, url string, place int"), parsed).collect()
    assert [(r.origin, r.url) for r in got] == [("o", "u")]


def test_csv_keeps_blanks_meta_and_absent_uids(spark, tmp_path):
    v = Row(sku="v", name="n", url="u", images=None, price=None, availability=None, options=[Row(id="size", value="L", uid="")])
    plain = Row(sku="w", name="n", url="u", images=None, price=None, availability=None, options=None)
    many = [Row(url=f"i{i}", label=None, roles=None) for i in range(13)]
    base = dict.fromkeys(f.name for f in PRODUCT.fields) | {"images": many, "path": "/p", "sku": "s", "name": "  lead trail  ", "metaTitle": "t", "metaDescription": 'd "q"\nx',
                                                            "variants": [v, plain]}
    df = spark.createDataFrame([tuple(base[f.name] for f in PRODUCT.fields)], PRODUCT)
    write_csv(flat_rows(df), str(tmp_path / "csv"))
    p = assemble_products(read_csv(spark, str(tmp_path / "csv"))).first()
    assert (p["name"], p["metaTitle"], p["metaDescription"]) == ("  lead trail  ", "t", 'd "q"\nx')
    assert [i["url"] for i in p["images"]] == [f"i{i}" for i in range(13)]
    assert p["options"][0]["values"][0]["uid"] is None
    assert {x["sku"]: x["options"] for x in p["variants"]}["w"] is None
