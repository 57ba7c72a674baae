"""Pure-Python tests of the E0 tokenizer and selector matching."""

from pyspark.sql import functions as F

from shelfline.operators.dom import parse_dom
from shelfline.operators.fields import PageFields, SelectorIndex, hrefs, read_fields, with_fields
from shelfline.operators.html import is_soft_404
from shelfline.operators.selectors import compound_ok, match_ancestors, parse_selector

PAGE = ('<html><head><title>T &amp; x</title><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>'
        '<div class="product"><h1 class="x">Name</h1><p><b>bold<br><p>two</p></div></body></html>')


def test_implied_end_tags_and_script_text():
    d = parse_dom(PAGE)
    tags = [e["tag"] for e in d["elements"]]
    assert tags.count("li") == 2 and tags.count("p") == 2
    script = [e for e in d["elements"] if e["tag"] == "script"][0]
    assert "".join(d["texts"][script["t0"]:script["t1"]]) == 'var t="</p>";'
    title = [e for e in d["elements"] if e["tag"] == "title"][0]
    assert "".join(d["texts"][title["t0"]:title["t1"]]) == "T & x"


def _hits(page, selectors):
    elems = parse_dom(page)["elements"]
    return elems, SelectorIndex(selectors).match(elems)


def test_selector_hits_in_document_order():
    els, hits = _hits(PAGE, ["h1", "nav a", ".product h1", "div > h1.x", "p", 'li a[href^="/b"]', "ul > a", "ul a, h1"])
    assert [els[i]["tag"] for i in hits[1]] == ["a", "a"]
    assert hits[0] == hits[2] == hits[3] and hits[7] == sorted(hits[1] + hits[0])
    assert len(hits[4]) == 2
    assert [els[i]["_amap"]["href"] for i in hits[5]] == ["/b"]
    assert hits[6] == []


def test_index_equals_trying_every_selector():
    from shelfline.operators.platforms import CATEGORY_SELECTORS, PLATFORM_SELECTORS
    selectors = [s for cfg in (*PLATFORM_SELECTORS.values(), *CATEGORY_SELECTORS.values()) for v in cfg.values() for s in v]
    selectors = [*dict.fromkeys(selectors), "*", "[data-sku]", "body *", "#a.b", "div#a", 'a[rel~="next"]', "a, .b, #a"]
    marks = ["price", "sku", "product-image", "product_meta", "stock", "gallery", "price-box", "b", "woocommerce-Price-amount"]
    page = "".join(f'<div class="{marks[i % 9]} {marks[i * 7 % 9]}" id="{"a" if i % 5 else "tab-description"}" data-sku="{i}">'
                   f'<a rel="x next" href="/p/{i}">t</a><h1 itemprop="name">n</h1><img src="i">{"</div>" if i % 3 else ""}' for i in range(60))
    elems, hits = _hits(page, selectors)
    for k, selector in enumerate(selectors):
        alternatives = [parse_selector(x) for x in selector.split(",")]
        assert hits[k] == [i for i in range(len(elems)) if any(
            compound_ok(elems, i, p[-1][1]) and match_ancestors(elems, p, len(p) - 1, i) for p in alternatives)], selector


def test_deep_page_stays_linear():
    n = 50_000
    rules = PageFields(fields={"x": [("div.none", "text"), ("div > p", "text")]})
    assert read_fields("<div>" * n + "x", rules, SelectorIndex(rules.selectors())) == {"x": None}
    assert parse_dom("<div>" * n + "x")["elements"][-1]["parent"] == n - 2


def test_rows_are_read_with_their_own_rules(spark):
    rules = {"a": PageFields(fields={"x": [("h2", "text"), ("h1", "text")]}, firsts={"y": [("h2", "text"), ("p", "text<4")]},
                             lists={"z": (["p", "h1"], ["@class", "text"])}),
             "b": PageFields(fields={"x": [("h1", "@class")]}, firsts={"y": []}, lists={"z": ([], ["@class", "text"])})}
    html = '<h1 class="c"> N\u00a0</h1><h2> \n</h2><p>long text</p><p>p</p>'
    rows = spark.createDataFrame([(1, "a", html), (2, "b", html), (3, "c", html), (4, "a", None), (5, None, html)], "k int, r string, html string")
    got = {r.k: (r.x, r.y, [tuple(z) for z in r.z] if r.z is not None else None) for r in with_fields(rows, rules, "r").collect()}
    assert got == {1: ("N", [" \n", None], [(None, "long text"), (None, "p"), ("c", " N\u00a0")]), 2: ("c", [], []),
                   3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    links = hrefs(spark.createDataFrame([(PAGE,)], "html string"), ["nav a", "a"], "links").first().links
    assert links == ["/a", "/b", "/a", "/b"]


def test_soft_404(spark):
    rows = [("Seite 404", "x"), (" Not \n Found ", ""), ("ok", "Page not found"), ("ok", None), (None, None), ("fine", "page  not found")]
    df = spark.createDataFrame(rows, "t string, b string")
    assert [r[0] for r in df.select(is_soft_404(F.col("t"), F.col("b"))).collect()] == [True, True, True, False, False, False]
