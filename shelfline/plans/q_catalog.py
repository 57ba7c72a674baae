"""Queries for the column operators, discovery, robots, crawl state,
facets, enrichment, batching and the flat CSV form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.enums import AVAILABILITY_MAP, CONDITION_MAP, normalize_availability, normalize_condition
from ..functions.prices import currency_from_symbol, parse_price
from ..functions.urls import url_origin
from ..operators import discovery as D
from ..operators import enrich as X
from ..operators import facets as FC
from ..operators import flat as FL
from ..operators import state as R
from ..schemas import CSV_COLUMNS, NUM_IMAGE_COLS
from ..sources.robots import robots_rules, rule_sets
from ..sources.tables import read_table
from . import standins as S
from .registry import query, sql_pathname, sql_product_path

# --- stand-in input vocabularies (fixed, used only to render inputs) ---------
AVAILABILITY_SPELLINGS = ["in stock", "https://schema.org/OutOfStock", "Pre-Order", " SOLD OUT ",
                          "http://schema.org/LimitedAvailability", "weird", "back order", "InStoreOnly"]
CONDITION_BY_TYPE = {"ECONOMY": "used", "SMALL": "https://schema.org/NewCondition", "MEDIUM": " Refurbished ",
                     "LARGE": "damaged", "PROMO": "new", "STANDARD": "mint"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_map_case(key: str, mapping: dict) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + " END"


def _sql_enum(x: str, mapping: dict) -> str:
    stripped = f"regexp_replace(regexp_replace({x}, 'https://schema\\.org/', ''), 'http://schema\\.org/', '')"
    key = f"lower(regexp_replace(lower({stripped}), '^\\s+|\\s+$', '', 'g'))"
    return _sql_map_case(key, mapping)


_AV_LIST = "[" + ", ".join(_q(s) for s in AVAILABILITY_SPELLINGS) + "]"


@query("availability_enum", f"""
SELECT l_orderkey, l_linenumber, t AS availability_text, {_sql_enum('t', AVAILABILITY_MAP)} AS availability
FROM (SELECT l_orderkey, l_linenumber, {_AV_LIST}[((l_orderkey + l_linenumber) % 8) + 1] AS t FROM lineitem)
""")
def availability_enum(spark, sf_dir):
    """T6 on an availability text rendered for every lineitem row."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    arr = F.array(*[F.lit(s) for s in AVAILABILITY_SPELLINGS])
    t = F.element_at(arr, (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8)) + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", t.alias("availability_text")) \
        .withColumn("availability", normalize_availability("availability_text"))


@query("condition_enum", f"""
SELECT p_partkey, t AS condition_text, {_sql_enum('t', CONDITION_MAP)} AS item_condition
FROM (SELECT p_partkey, {_sql_map_case('p_type', CONDITION_BY_TYPE)} AS t FROM part)
""")
def condition_enum(spark, sf_dir):
    """T7 on a condition text rendered per part type."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    m = F.create_map(*[F.lit(x) for kv in CONDITION_BY_TYPE.items() for x in kv])
    return part.select("p_partkey", F.try_element_at(m, F.col("p_type")).alias("condition_text")) \
        .withColumn("item_condition", normalize_condition("condition_text"))


def _price_text_spark():
    s = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    k = F.pmod(F.col("p_partkey"), F.lit(4))
    txt = (F.when(k == 0, F.concat(F.lit("$"), s))
           .when(k == 1, F.concat(F.regexp_replace(s, r"\.", ","), F.lit(" €")))
           .when(k == 2, F.concat(F.lit("R$ 1."), F.regexp_replace(s, r"\.", ",")))
           .otherwise(F.concat(F.lit("kr 1,"), s)))
    return F.when(F.pmod(F.col("p_size"), F.lit(13)) == 0, F.lit("Free")).otherwise(txt)


_PRICE_TEXT_SQL = """CASE WHEN p_size % 13 = 0 THEN 'Free'
  WHEN p_partkey % 4 = 0 THEN '$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
  WHEN p_partkey % 4 = 1 THEN replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') || ' €'
  WHEN p_partkey % 4 = 2 THEN 'R$ 1.' || replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
  ELSE 'kr 1,' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END"""


@query("price_parse", f"""
WITH t AS (SELECT p_partkey, {_PRICE_TEXT_SQL} AS price_text FROM part),
c AS (SELECT p_partkey, price_text, regexp_replace(price_text, '[^0-9.,]', '', 'g') AS c FROM t),
o AS (SELECT p_partkey, price_text, c,
  CASE WHEN regexp_full_match(c, '\\d{{1,3}}(\\.\\d{{3}})*(,\\d{{2}})?') THEN replace(replace(c, '.', ''), ',', '.')
       WHEN regexp_full_match(c, '\\d{{1,3}}(,\\d{{3}})*(\\.\\d{{2}})?') THEN replace(c, ',', '')
       WHEN regexp_full_match(c, '\\d+,\\d{{2}}') THEN replace(c, ',', '.')
       ELSE c END AS o FROM c)
SELECT p_partkey, price_text, CASE WHEN c <> '' AND regexp_matches(o, '^(\\d|\\.\\d)') THEN o END AS price FROM o
""")
def price_parse(spark, sf_dir):
    """E17 on price texts rendered from part prices in four regional formats."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return part.select("p_partkey", _price_text_spark().alias("price_text")) \
        .withColumn("price", parse_price("price_text"))


@query("currency_detect", f"""
SELECT p_partkey, price_text,
  CASE WHEN contains(price_text, '$') THEN 'USD' WHEN contains(price_text, '€') THEN 'EUR'
       WHEN contains(price_text, '£') THEN 'GBP' WHEN contains(price_text, '¥') THEN 'JPY'
       WHEN contains(price_text, '₹') THEN 'INR' WHEN contains(price_text, '₩') THEN 'KRW'
       WHEN contains(price_text, 'R$') THEN 'BRL' WHEN contains(price_text, 'kr') THEN 'SEK'
       WHEN contains(price_text, 'CHF') THEN 'CHF' WHEN contains(price_text, 'A$') THEN 'AUD'
       WHEN contains(price_text, 'C$') THEN 'CAD' END AS currency
FROM (SELECT p_partkey, {_PRICE_TEXT_SQL} AS price_text FROM part)
""")
def currency_detect(spark, sf_dir):
    """E16 on the same rendered price texts."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return part.select("p_partkey", _price_text_spark().alias("price_text")) \
        .withColumn("currency", currency_from_symbol("price_text"))


def _sql_contains_any(x: str, pats: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_q(p)})" for p in pats) + ")"


@query("url_filter", f"""
SELECT page_id, url, {_sql_contains_any('url', D.product_url_patterns())} AS generic_product,
       {_sql_contains_any('url', D.product_url_patterns('magento'))} AS magento_product,
       {_sql_contains_any('url', D.product_url_patterns('shopify', ['/en/']))} AS custom_product
FROM pages
""")
def url_filter(spark, sf_dir):
    """D1 product-URL predicate: defaults, a platform list, custom + platform."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", "url", D.is_product_url("url").alias("generic_product"),
                        D.is_product_url("url", "magento").alias("magento_product"),
                        D.is_product_url("url", "shopify", ["/en/"]).alias("custom_product"))


@query("url_dedupe", """
SELECT url, min(page_id) AS ordinal
FROM (SELECT split_part(split_part(url, '?', 1), '#', 1) AS url, page_id FROM pages) GROUP BY url
""")
def url_dedupe(spark, sf_dir):
    """D3: every URL once, with its first encounter."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return D.dedupe_first(pages.select(
        F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("url"), F.col("page_id").alias("ordinal")))


@query("url_dedupe_cap", """
SELECT url, min(page_id) AS ordinal
FROM (SELECT split_part(split_part(url, '?', 1), '#', 1) AS url, page_id FROM pages)
GROUP BY url ORDER BY ordinal LIMIT 100
""")
def url_dedupe_cap(spark, sf_dir):
    """D3 dedupe (first encounter) then D4 cap of 100 in discovery order."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    found = pages.select(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("url"),
                         F.col("page_id").alias("ordinal"))
    return D.cap(D.dedupe_first(found), 100)


@query("robots_filter", f"""
SELECT page_id, url,
  (starts_with({sql_pathname('url')}, '/de/1') OR NOT (starts_with({sql_pathname('url')}, '/de/')
   OR starts_with({sql_pathname('url')}, '/fr/9'))) AS allowed,
  2.5 AS crawl_delay, 1 AS n_sitemaps
FROM pages
""")
def robots_filter(spark, sf_dir):
    """S5 robots parsing per site, then D2 allow/deny on every page URL."""
    lines = robots_rules(S.robots_files(spark, sf_dir))
    rules = rule_sets(lines)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = D.apply_robots(pages, lines)
    meta = rules.select(F.col("origin").alias("_o"), "crawl_delay", F.size("sitemaps").alias("n_sitemaps"))
    return out.join(meta, url_origin(out.url) == meta._o, "left").select(
        "page_id", "url", "allowed", "crawl_delay", F.col("n_sitemaps").cast("int").alias("n_sitemaps"))


def _crawl_state(spark, sf_dir):
    ev = S.crawl_events(spark, sf_dir)
    disc = ev.filter(F.col("status") == "discovered").groupBy("url").agg(
        F.min_by("event_id", "seq").alias("ordinal"))
    state = R.upsert_frontier(None, disc)
    outcomes = ev.filter(F.col("status") != "discovered")
    return R.apply_outcomes(state, outcomes)


_STATE_SQL = """
WITH ev AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, ts, event_id, event_type,
  CASE WHEN event_type = 'signup' THEN 'discovered' WHEN event_type IN ('view', 'purchase') THEN 'crawled'
       WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'skipped' END AS st,
  CASE WHEN event_type = 'error' THEN 'error event ' || CAST(event_id AS VARCHAR)
       WHEN event_type = 'click' THEN 'No product data found' END AS err FROM events),
d AS (SELECT url, arg_min(event_id, (ts, event_id)) AS ordinal FROM ev WHERE st = 'discovered' GROUP BY url),
l AS (SELECT url, arg_max(st, (ts, event_id)) AS s,
        max(CASE WHEN st = 'crawled' THEN ts END) AS at,
        arg_max(err, CASE WHEN st IN ('failed', 'skipped') THEN (ts, event_id) END) AS e
      FROM ev WHERE st <> 'discovered' GROUP BY url),
state AS (SELECT d.url, coalesce(l.s, 'pending') AS status, l.e AS error, l.at AS crawled_at, d.ordinal
          FROM d LEFT JOIN l ON d.url = l.url)
"""


@query("state_upsert", _STATE_SQL + "SELECT url, status, error, crawled_at, ordinal FROM state")
def state_upsert(spark, sf_dir):
    """R1 frontier upsert + R2 status transitions over the whole event log."""
    return _crawl_state(spark, sf_dir).select("url", "status", "error", "crawled_at", "ordinal")


@query("state_stats", _STATE_SQL + """
, a AS (SELECT count(*) AS discovered, count(*) FILTER (WHERE status = 'crawled') AS crawled,
          count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped
        FROM state)
SELECT discovered, crawled, failed, skipped, discovered - crawled - failed - skipped AS pending,
  printf('%.1f%%', crawled * 100.0 / discovered) AS crawled_pct, printf('%.1f%%', failed * 100.0 / discovered) AS failed_pct,
  printf('%.1f%%', skipped * 100.0 / discovered) AS skipped_pct,
  printf('%.1f%%', (discovered - crawled - failed - skipped) * 100.0 / discovered) AS pending_pct,
  (discovered - crawled - failed - skipped) = 0 AS complete
FROM a
""")
def state_stats(spark, sf_dir):
    """R4 stats, R5 percentages, R7 completion flag in one aggregation."""
    return R.stats(_crawl_state(spark, sf_dir))


@query("state_failures", _STATE_SQL + """
SELECT url, error, ordinal FROM state WHERE status = 'failed' ORDER BY ordinal LIMIT 10
""")
def state_failures(spark, sf_dir):
    """The first 10 failed keys in insertion order."""
    return R.recent_failures(_crawl_state(spark, sf_dir))


@query("facet_scalar", """
WITH s AS (SELECT 'p_brand' AS facet, CAST(p_brand AS VARCHAR) AS value FROM part
           UNION ALL SELECT 'p_type', CAST(p_type AS VARCHAR) FROM part
           UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT facet, value, count(*) AS count FROM s GROUP BY facet, value)
SELECT facet, value, count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS BIGINT) AS rank FROM c)
WHERE rank <= 20
""")
def facet_scalar(spark, sf_dir):
    """top-20 value buckets for brand, type and size."""
    part = read_table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    return FC.scalar_facets(part, ["p_brand", "p_type", "p_size"]).withColumn("rank", F.col("rank").cast("long"))


@query("facet_range", """
SELECT CAST(floor(p_retailprice / 10) * 10 AS DOUBLE) AS "from", CAST(floor(p_retailprice / 10) * 10 + 10 AS DOUBLE) AS "to",
       count(*) AS count FROM part GROUP BY 1, 2
""")
def facet_range(spark, sf_dir):
    """price buckets of width 10."""
    part = read_table(spark, sf_dir, "part").select("p_retailprice")
    r = FC.range_facet(part, "p_retailprice", 10.0)
    return r.select(F.col("from").cast("double").alias("from"), F.col("to").cast("double").alias("to"), "count")


@query("facet_stats", "SELECT min(p_retailprice) AS min, max(p_retailprice) AS max FROM part")
def facet_stats(spark, sf_dir):
    """price min and max."""
    return FC.stats_facet(read_table(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice")


_PATHS_SQL = """paths AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS path FROM part
   UNION SELECT DISTINCT split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1) FROM part)"""


@query("facet_tree", f"""
WITH {_PATHS_SQL},
nodes AS (SELECT path AS node, string_split(path, '/')[-1] AS name, len(string_split(path, '/')) AS level,
  CASE WHEN len(string_split(path, '/')) > 1 THEN array_to_string(string_split(path, '/')[1:-2], '/') END AS parent
  FROM paths),
kids AS (SELECT parent AS node, string_agg(name, '|' ORDER BY name) AS children FROM nodes WHERE parent IS NOT NULL
  GROUP BY parent)
SELECT n.node, n.name, CAST(n.level AS INTEGER) AS level, n.parent, coalesce(k.children, '') AS children
FROM nodes n LEFT JOIN kids k ON n.node = k.node
""")
def facet_tree(spark, sf_dir):
    """category tree (name, level, parent, children) from category paths."""
    part = read_table(spark, sf_dir, "part").select("p_name")
    paths = part.select(F.split("p_name", " ").getItem(1).alias("path")).unionByName(
        part.select(F.concat_ws("/", F.split("p_name", " ").getItem(1), F.split("p_name", " ").getItem(0)).alias("path")))
    return FC.category_tree(paths).select("node", "name", F.col("level").cast("int").alias("level"), "parent",
                                          "children")


def _sql_name_class(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN regexp_matches({x}, {_q('(?i)' + p)}) THEN {_q(c)}"
                               for c, p in X.NAME_CLASS_RULES) + " ELSE 'other' END")


@query("name_class", f"SELECT p_partkey, p_name, {_sql_name_class('p_name')} AS class FROM part")
def name_class(spark, sf_dir):
    """Ordered regex rules over every product name."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.withColumn("class", X.name_class("p_name"))


@query("class_histogram", f"""
SELECT class, count(*) AS count FROM (SELECT {_sql_name_class('p_name')} AS class FROM part) GROUP BY class
""")
def class_histogram(spark, sf_dir):
    """Products per name class."""
    part = read_table(spark, sf_dir, "part").select("p_name")
    return X.class_histogram(part.withColumn("class", X.name_class("p_name")))


def _membership(part):
    sku = F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku")
    w2, w1 = F.split("p_name", " ").getItem(1), F.split("p_name", " ").getItem(0)
    m = part.select(sku, w2.alias("path")).unionByName(part.select(sku, F.concat_ws("/", w2, w1).alias("path"))) \
        .unionByName(part.select(sku, F.lit("all-products").alias("path"))) \
        .unionByName(part.filter(F.col("p_size") > 45).select(sku, F.lit("featured").alias("path")))
    return m


@query("category_paths", """
WITH m AS (SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku, split_part(p_name, ' ', 2) AS path FROM part
  UNION ALL SELECT 'P-' || CAST(p_partkey AS VARCHAR), split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1) FROM part
  UNION ALL SELECT 'P-' || CAST(p_partkey AS VARCHAR), 'all-products' FROM part
  UNION ALL SELECT 'P-' || CAST(p_partkey AS VARCHAR), 'featured' FROM part WHERE p_size > 45)
SELECT sku, coalesce(string_agg(path, '|' ORDER BY len(string_split(path, '/')) DESC, path)
                     FILTER (WHERE path NOT IN ('all-products', 'featured')), '') AS categories
FROM m GROUP BY sku
""")
def category_paths(spark, sf_dir):
    """X5 membership join + X6 cleanup and ordering (deepest first)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    prods = part.select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"))
    out = X.assign_categories(prods, _membership(part))
    return out.select("sku", F.array_join("categories", "|").alias("categories"))


@query("related_ring", f"""
WITH p AS (SELECT '/products/p-' || CAST(p_partkey AS VARCHAR) AS path, {_sql_name_class('p_name')} AS class FROM part),
r AS (SELECT path, class, row_number() OVER (PARTITION BY class ORDER BY md5(path), path) AS r,
             count(*) OVER (PARTITION BY class) AS m FROM p),
w AS (SELECT r.path, r.class, k.k, ((r.r - 1 + k.k) % r.m) + 1 AS pr FROM r, range(1, 6) k(k) WHERE r.m > 5)
SELECT w.path, CAST(w.k AS INTEGER) AS rank, r.path AS related FROM w JOIN r ON w.class = r.class AND w.pr = r.r
""")
def related_ring(spark, sf_dir):
    """Five related products per product from its name class (hash ring)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    prods = part.select(F.concat(F.lit("/products/p-"), F.col("p_partkey").cast("string")).alias("path"),
                        X.name_class("p_name").alias("class"))
    return X.related_ring(prods).select("path", F.col("rank").cast("int").alias("rank"), "related")


@query("batch_plan", """
SELECT batch, count(*) AS n, string_agg(sku, '|' ORDER BY path, sku) AS skus FROM (
  SELECT sku, path, (row_number() OVER (ORDER BY path, sku) - 1) // 50 AS batch
  FROM (SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku, """ + sql_product_path(
    "'https://store.example.com/' || split_part(p_name, ' ', 2) || '/' || CAST(p_partkey AS VARCHAR) || '.html'")
    + """ AS path FROM part))
GROUP BY batch
""")
def batch_plan(spark, sf_dir):
    """Delivery batches of 50 in path order (two-pass global index)."""
    prods = S.part_products(spark, sf_dir).select("sku", "path")
    plan = R.batch_plan(prods, "path", "sku")
    return plan.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "sku"))), lambda x: x["sku"]), "|").alias("skus"))


@query("delivery_summary", """
WITH p AS (SELECT (row_number() OVER (ORDER BY path) - 1) // 50 AS batch FROM (SELECT """ + sql_product_path(
    "'https://store.example.com/' || split_part(p_name, ' ', 2) || '/' || CAST(p_partkey AS VARCHAR) || '.html'")
    + """ AS path FROM part)),
b AS (SELECT batch, count(*) AS n, CASE WHEN batch = 5 THEN 401 WHEN batch % 7 = 3 THEN 500 ELSE 200 END AS code
      FROM p GROUP BY batch),
c AS (SELECT min(batch) FILTER (WHERE code IN (401, 403)) AS cut FROM b),
k AS (SELECT b.* FROM b, c WHERE c.cut IS NULL OR b.batch <= c.cut)
SELECT CAST(sum(n) AS BIGINT) AS counted,
       CAST(coalesce(sum(n) FILTER (WHERE code BETWEEN 200 AND 299), 0) AS BIGINT) AS uploaded,
       CAST(coalesce(sum(n) FILTER (WHERE code NOT BETWEEN 200 AND 299), 0) AS BIGINT) AS failed, 0 AS skipped,
       CAST(coalesce(sum(n) FILTER (WHERE code NOT BETWEEN 200 AND 299), 0) AS BIGINT) AS failed_skus,
       min(batch) FILTER (WHERE code NOT BETWEEN 200 AND 299) AS first_failed_batch
FROM k
""")
def delivery_summary(spark, sf_dir):
    """Totals over per-batch outcomes; a 401 stops later accounting."""
    prods = S.part_products(spark, sf_dir).select("sku", "path")
    plan = R.batch_plan(prods, "path", "sku")
    batches = plan.select("batch").distinct()
    outcomes = batches.select("batch", F.when(F.col("batch") == 5, 401).when(F.col("batch") % 7 == 3, 500)
                              .otherwise(200).alias("status_code"))
    out = R.delivery_summary(plan, outcomes)
    return out.select(F.col("counted").cast("long"), F.col("uploaded").cast("long"), F.col("failed").cast("long"),
                      F.col("skipped").cast("int"), F.col("failed_skus").cast("long"),
                      F.col("first_failed_batch").cast("long"))


_FLAT_PARENT_SQL = """SELECT 'parent' AS type, 'P-' || CAST(p_partkey AS VARCHAR) AS sku, '' AS parent_sku, p_name AS name,
  {path} AS path, {url} AS url, '' AS description, '' AS meta_title, '' AS meta_description, 'USD' AS price_currency,
  '' AS price_regular, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price_final, 'InStock' AS availability,
  {imgs}, '' AS option_size, '' AS option_color, '' AS option_size_uid, '' AS option_color_uid, '' AS categories,
  '' AS related FROM part"""
_URL_SQL = "'https://store.example.com/' || split_part(p_name, ' ', 2) || '/' || CAST(p_partkey AS VARCHAR) || '.html'"
_IMGS_SQL = ", ".join([f"'' AS image_{i}" for i in range(1, NUM_IMAGE_COLS + 1)]
                      + [f"'' AS image_{i}_roles" for i in range(1, NUM_IMAGE_COLS + 1)])
_FLAT_SQL = (f"""WITH pr AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS ln,
  arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS rf FROM lineitem GROUP BY l_partkey, l_suppkey),
rows AS (""" + _FLAT_PARENT_SQL.format(path=sql_product_path(_URL_SQL), url=_URL_SQL, imgs=_IMGS_SQL) + f"""
UNION ALL
SELECT 'variant', 'P-' || CAST(l_partkey AS VARCHAR) || '-S-' || CAST(l_suppkey AS VARCHAR),
  'P-' || CAST(l_partkey AS VARCHAR), p_name, '', {_URL_SQL} || '?supplier=' || CAST(l_suppkey AS VARCHAR),
  '', '', '', 'USD', '', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR),
  CASE rf WHEN 'N' THEN 'InStock' WHEN 'A' THEN 'OutOfStock' ELSE '' END, {_IMGS_SQL.replace("'' AS ", "'' AS v_")},
  CAST(ln AS VARCHAR), split_part(p_name, ' ', 1), 'S' || CAST(l_suppkey AS VARCHAR),
  'C' || CAST(l_suppkey AS VARCHAR), '', ''
FROM pr JOIN part ON pr.l_partkey = part.p_partkey)
""")


@query("flat_rows", _FLAT_SQL + "SELECT " + ", ".join(CSV_COLUMNS) + " FROM rows")
def flat_rows(spark, sf_dir):
    """Products and their variants as wide CSV rows (39 columns)."""
    prods = S.part_products(spark, sf_dir)
    variants = S.lineitem_variants(spark, sf_dir).select("parent_sku", "v")
    return FL.flat_rows(prods, variants)


@query("flat_counts", _FLAT_SQL + "SELECT type, count(*) AS count FROM rows GROUP BY type")
def flat_counts(spark, sf_dir):
    """Parent and variant row counts of the flat file."""
    prods = S.part_products(spark, sf_dir)
    variants = S.lineitem_variants(spark, sf_dir).select("parent_sku", "v")
    return FL.flat_counts(FL.flat_rows(prods, variants))
