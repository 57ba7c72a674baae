"""URL handling as Catalyst expressions (T1, T2, URL resolution for D5/D6/E18).

The JavaScript ``URL`` class percent-encodes spaces and non-ASCII characters
in the path, resolves dot segments and reports ``/`` for a bare host.  Spark's
``parse_url`` does none of that, so the pathname is cut out with a regex and
normalised here.  Every function takes and returns a ``Column``; nothing runs
in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, let

# --- fixed values (must equal the reference's rules) -------------------------
# Extensions stripped from the last path segment, tested in this order.
STRIP_EXTENSIONS = [".html", ".htm", ".php", ".aspx", ".jsp", ".shtml"]
# Product path pattern and its maximum length.
PATH_PATTERN = r"^/([a-z0-9_]+([-_][a-z0-9_]+)*/)*[a-z0-9]+(-[a-z0-9]+)*$"
MAX_PATH_LENGTH = 900
# ----------------------------------------------------------------------------

SPECIAL_SCHEMES = ["http", "https", "ws", "wss", "ftp", "file"]
_SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
# characters the URL path state leaves as they are (printable ASCII minus the
# path percent-encode set: space " # < > ? ` { })
_PATH_SAFE_RE = r"^[!$-;=@-_a-z|~]$"


def _percent_encode_path(path: Column) -> Column:
    def encoded(ch):
        return F.when(ch == " ", F.lit("%20")).when(ch.rlike(_PATH_SAFE_RE) | ch.isin("%", "/", "\\"), ch).otherwise(F.url_encode(ch))
    return let(path, lambda p: F.when(p.rlike(r"[^!$-;=@-_a-z|~%/\\]"), F.array_join(F.transform(F.split(p, ""), encoded), ""))
               .otherwise(p))


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal for an absolute path (starts with '/');
    a path without a dot segment is only tested."""
    dot, up = F.array(*map(F.lit, [".", "%2e"])), F.array(*map(F.lit, ["..", ".%2e", "%2e.", "%2e%2e"]))

    def resolved(segs):
        kept = F.aggregate(
            segs, F.array().cast("array<string>"),
            lambda acc, s: F.when(F.array_contains(dot, F.lower(s)), acc)
            .when(F.array_contains(up, F.lower(s)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s)))
        last = F.lower(F.try_element_at(segs, F.lit(-1)))
        trail = F.when(F.array_contains(dot, last) | F.array_contains(up, last), F.lit("/")).otherwise(F.lit(""))
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), trail), "//$", "/")
    return let(path, lambda p: F.when(
        p.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), let(F.split(F.substring(p, F.lit(2), F.length(p)), "/", -1), resolved)).otherwise(p))


def url_pathname(url) -> Column:
    """``new URL(url).pathname``; NULL when the URL does not parse.  Every
    value that is needed twice is bound once, so the expression stays small."""
    def special(after, is_file):
        # skip slashes, cut the authority; the path runs to ? or #
        def cut(rest):
            host = F.regexp_extract(rest, r"^([^/\\?#]*)", 1)
            path = let(F.translate(F.regexp_extract(rest, r"^[^/\\?#]*([^?#]*)", 1), "\\", "/"),
                       lambda p: F.when(p == "", F.lit("/")).otherwise(_remove_dot_segments(_percent_encode_path(p))))
            return F.when(is_file | ((host != "") & ~host.rlike(r"[\s<>^|%]")), path)
        return let(F.regexp_replace(after, r"^[/\\]*", ""), cut)

    def other(after):  # an authority only after '//', else an opaque path
        return F.regexp_extract(after, r"^(?://[^/?#]*)?([^?#]*)", 1)

    def parse(u):
        scheme = F.lower(F.regexp_extract(u, _SCHEME_RE, 1))
        return let(F.struct(scheme.alias("scheme"), F.regexp_replace(u, _SCHEME_RE, "").alias("after")),
                   lambda x: F.when(x["scheme"].isin(*SPECIAL_SCHEMES), special(x["after"], x["scheme"] == "file"))
                   .when(x["scheme"] != "", other(x["after"])))
    clean = F.regexp_replace(F.regexp_replace(col_(url), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return let(clean, parse)


def url_origin(url) -> Column:
    """``new URL(url).origin`` for http(s) URLs (scheme://host[:port])."""
    return F.regexp_extract(col_(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def resolve_url(href, base) -> Column:
    """``new URL(href, base).href`` for the forms found in pages: absolute,
    scheme-relative, root-relative, query/fragment-only and document-relative.
    The candidate is assembled first and normalised once (lower-case origin,
    percent-encoded path, dot segments removed)."""
    h = F.regexp_replace(col_(href), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    b = col_(base)
    origin = url_origin(b)
    base_path = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base_dir = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    scheme = F.regexp_extract(b, _SCHEME_RE, 1)
    web = r"(?i)^(https?|wss?|ftp)://"
    cand = (F.when(h.rlike(_SCHEME_RE), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h == "", F.regexp_extract(b, r"^([^#]*)", 1))
            .when(h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
            .otherwise(F.concat(origin, base_dir, h)))

    def norm(u):
        o = url_origin(u)
        rest = F.substring(u, F.length(o) + 1, F.length(u))
        p = F.regexp_extract(rest, r"^([^?#]*)", 1)
        tail = F.substring(rest, F.length(p) + 1, F.length(rest))
        p = F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, r"\\", "/"))
        p = let(p, lambda q: _remove_dot_segments(_percent_encode_path(q)))
        return F.when(u.rlike(web), F.concat(F.lower(o), p, tail)).otherwise(u)
    return F.when(h.isNull() | b.isNull(), None).otherwise(let(cand, norm))


def product_path(url, prefix: str | None = None) -> Column:
    """Source URL -> product path, NULL when no valid path results."""
    ext_re = "(?i)(" + "|".join(e.replace(".", r"\.") for e in STRIP_EXTENSIONS) + ")$"
    head = (prefix if prefix.startswith("/") else "/" + prefix) if prefix else ""

    def path_of(pathname):
        bare = F.lower(F.regexp_replace(pathname, ext_re, ""))
        # a trailing slash, empty segments and dashes around segments go with the empty parts
        dashed = F.regexp_replace(bare, r"[^a-z0-9/]+", "-")
        segs = F.array_remove(F.split(F.regexp_replace(dashed, r"(^|/)-|-(?=/|$)", "$1"), "/"), "")
        return F.regexp_replace(F.concat(F.lit(head + "/"), F.array_join(segs, "/")), "/{2,}", "/")

    def valid(path):
        return F.when((F.length(path) <= MAX_PATH_LENGTH) & path.rlike(PATH_PATTERN), path)
    u = col_(url)
    cut = F.split_part(F.split_part(u, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.when(u.isNotNull(), let(let(F.coalesce(url_pathname(u), cut), path_of), valid))


def sanitize_sku(sku) -> Column:
    """``sku ? String(sku).trim() : ''`` (NULL -> '')."""
    from .text import js_trim
    return F.coalesce(js_trim(col_(sku)), F.lit(""))


def sku_from_url(url) -> Column:
    """Fallback SKU from the last path segment."""
    u = col_(url)
    pathname = F.coalesce(url_pathname(u), u)
    segs = F.filter(F.split(pathname, "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit("unknown"))
    s = F.regexp_replace(last, r"\.[^.]+$", "")
    s = F.upper(s)
    s = F.regexp_replace(s, r"[^A-Z0-9]", "-")
    s = F.regexp_replace(s, r"-{2,}", "-")
    s = F.regexp_replace(s, r"^-|-$", "")
    return s
