"""Literal-row tests for discovery, robots, crawl state, categories, delivery
and option rebuilding (FIXTURES.md part B)."""

from pyspark.sql import functions as F

from shelfline.operators import discovery as D
from shelfline.operators import enrich as X
from shelfline.operators import state as R
from shelfline.operators.flat import assemble_products
from shelfline.operators.transform import top_level_options
from shelfline.schemas import CSV_COLUMNS
from shelfline.sources.robots import robots_rules, rule_sets


def test_product_url_predicate(spark):
    df = spark.createDataFrame([("https://s.com/x.html",)], "url string")
    r = df.select(D.is_product_url("url", "magento").alias("m"), D.is_product_url("url").alias("g")).first()
    assert r.m is True and r.g is False


def test_robots_allow_before_deny(spark):
    robots = spark.createDataFrame([("https://s.com", "User-agent: *\nDisallow: /p\nAllow: /p/a\n"
                                                      "User-agent: other\nDisallow: /\nCrawl-delay: 9")],
                                   "origin string, text string")
    lines = robots_rules(robots)
    rules = rule_sets(lines)
    urls = spark.createDataFrame([("https://s.com/p/a1",), ("https://s.com/p/b",), ("https://s.com/q",)], "url string")
    got = {r.url: r.allowed for r in D.apply_robots(urls, lines).collect()}
    assert got == {"https://s.com/p/a1": True, "https://s.com/p/b": False, "https://s.com/q": True}
    assert rules.first().crawl_delay == 0.0


def test_state_upsert_transitions_and_stats(spark):
    disc = spark.createDataFrame([("product-1", 1), ("product-2", 2), ("product-3", 3), ("product-1", 4)],
                                 "url string, ordinal long")
    state = R.upsert_frontier(None, disc)
    outcomes = spark.createDataFrame([("product-1", 1, "crawled", None), ("product-2", 2, "failed", "boom"),
                                      ("unknown", 3, "crawled", None)],
                                     "url string, seq long, status string, error string") \
        .withColumn("at", F.current_timestamp())
    state = R.apply_outcomes(state, outcomes)
    s = R.stats(state).first()
    assert (s.discovered, s.crawled, s.failed, s.pending, s.complete) == (3, 1, 1, 1, False)
    assert [r.url for r in R.pending(state).collect()] == ["product-3"]
    assert s.crawled_pct == "33.3%"


def test_category_cleanup_order(spark):
    prods = spark.createDataFrame([("S1",), ("S2",)], "sku string")
    m = spark.createDataFrame([("S1", "all-products"), ("S1", "apparel"), ("S1", "apparel/hats"),
                               ("S2", "featured")], "sku string, path string")
    got = {r.sku: r.categories for r in X.assign_categories(prods, m).collect()}
    assert got == {"S1": ["apparel/hats", "apparel"], "S2": []}


def test_delivery_stops_after_auth_failure(spark):
    plan = spark.createDataFrame([(b, f"s{b}-{i}") for b in range(5) for i in range(2)], "batch long, sku string")
    outcomes = spark.createDataFrame([(0, 200), (1, 500), (2, 401), (3, 200), (4, 200)],
                                     "batch long, status_code int")
    r = R.delivery_summary(plan, outcomes).first()
    assert (r.counted, r.uploaded, r.failed) == (6, 2, 4)


def test_uid_first_wins_in_transform_last_wins_in_csv(spark):
    opt_t = "array<struct<id:string,value:string,uid:string>>"
    v = spark.createDataFrame([([("color", "Red", "u1")],), ([("color", "Red", "u2")],)], f"options {opt_t}") \
        .agg(F.collect_list(F.struct("options")).alias("vs"))
    opts = v.select(top_level_options(F.col("vs")).alias("o")).first().o
    assert opts[0]["values"][0]["uid"] == "u1" and opts[0]["label"] == "Color"
    rows = [dict.fromkeys(CSV_COLUMNS, "") for _ in range(3)]
    rows[0].update(type="parent", sku="P", name="N", path="/p")
    rows[1].update(type="variant", sku="V1", parent_sku="P", option_color="Red", option_color_uid="u1")
    rows[2].update(type="variant", sku="V2", parent_sku="P", option_color="Red", option_color_uid="u2")
    df = spark.createDataFrame([tuple(r[c] for c in CSV_COLUMNS) + (i,) for i, r in enumerate(rows)],
                               ", ".join(f"{c} string" for c in CSV_COLUMNS) + ", _row long")
    p = assemble_products(df).first()
    assert p.options[0]["values"][0]["uid"] == "u2" and len(p.variants) == 2
