"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)``; the registered callable first sends the
    package to the executors."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            from ..session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- shared SQL fragments for oracles (DuckDB dialect) -----------------------

def sql_pathname(url: str) -> str:
    p = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def sql_product_path(url: str) -> str:
    pn = sql_pathname(url)
    p1 = f"regexp_replace({pn}, '(?i)\\.(html|htm|php|aspx|jsp|shtml)$', '')"
    p2 = f"(CASE WHEN length({p1}) > 1 AND suffix({p1}, '/') THEN substr({p1}, 1, length({p1}) - 1) ELSE {p1} END)"
    p3 = f"regexp_replace(regexp_replace(lower({p2}), '[^a-z0-9/\\-]', '-', 'g'), '-{{2,}}', '-', 'g')"
    segs = (f"list_filter(list_transform(list_filter(string_split({p3}, '/'), lambda s: s <> ''), "
            f"lambda s: regexp_replace(s, '^-+|-+$', '', 'g')), lambda s: s <> '')")
    path = f"('/' || array_to_string({segs}, '/'))"
    return (f"(CASE WHEN length({path}) <= 900 AND regexp_full_match({path}, "
            f"'/([a-z0-9_]+([-_][a-z0-9_]+)*/)*[a-z0-9]+(-[a-z0-9]+)*') THEN {path} END)")


def sql_sku_from_url(url: str) -> str:
    pn = sql_pathname(url)
    last = f"coalesce(list_filter(string_split({pn}, '/'), lambda s: s <> '')[-1], 'unknown')"
    s = f"upper(regexp_replace({last}, '\\.[^.]+$', ''))"
    s = f"regexp_replace(regexp_replace({s}, '[^A-Z0-9]', '-', 'g'), '-{{2,}}', '-', 'g')"
    return f"regexp_replace({s}, '^-|-$', '', 'g')"


def sql_decode_entities(x: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x


def sql_js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"


def sql_tag_text(html: str, tag: str) -> str:
    """Text of the first <tag> element (no nested same tag), entity-decoded."""
    inner = f"regexp_extract({html}, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    return sql_decode_entities(f"regexp_replace({inner}, '<[^>]*>', '', 'g')")
