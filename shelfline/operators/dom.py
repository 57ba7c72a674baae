"""HTML -> elements, the base for every selector rule.

``parse_dom`` tokenizes one page with the standard library ``html.parser``;
``fields.with_fields`` runs it in the only Python stage of the page path and
returns the values a plan asks for.  A page is

``texts``     text nodes in document order (entities decoded; script and
              style content raw, as browsers do)
``elements``  one record per element in document order:
              ``eid, parent, tag, id, classes, _amap, t0, t1, h0, h1``

``parent`` is the enclosing element's ``eid`` (-1: none).  ``[t0, t1)`` is the element's
slice of ``texts`` (so ``textContent`` is a join of that slice) and
``[h0, h1)`` the character offsets of its inner HTML in the page source.
Storing ranges instead of strings keeps the output linear in the page size
whatever the nesting depth.

The tree builder applies the implied end tags that matter for real pages
(``p`` closed by block starts, ``li``/``dt``/``dd``/``option``/``tr``/``td``
closed by siblings, void elements never opened).  Inner HTML is the source
slice, not a browser re-serialisation.
"""

from __future__ import annotations

from html.parser import HTMLParser

#: HTML characters of the pages of one output batch.
BATCH_CHARS = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
P_CLOSERS = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE_STOP = frozenset("html table td th caption marquee object template button".split())


class _TreeBuilder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.src = html
        self.line_starts = [0]
        pos = html.find("\n")
        while pos != -1:
            self.line_starts.append(pos + 1)
            pos = html.find("\n", pos + 1)
        self.texts: list[str] = []
        self.elems: list[dict] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}  # open elements by tag: a tag that is not open is not searched for

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def _close_top(self, at: int) -> None:
        e = self.elems[self.stack.pop()]
        self.open[e["tag"]] -= 1
        e["t1"] = len(self.texts)
        e["h1"] = at

    def _close_through(self, idx: int, at: int) -> None:
        while len(self.stack) > idx:
            self._close_top(at)

    def _find_open(self, tags, stops) -> int:
        if not any(self.open.get(t) for t in tags):
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.elems[self.stack[i]]["tag"]
            if t in tags:
                return i
            if t in stops:
                return -1
        return -1

    def _implied_ends(self, tag: str, at: int) -> None:
        if tag in P_CLOSERS:
            i = self._find_open(("p",), SCOPE_STOP)
            if i >= 0:
                self._close_through(i, at)
        if tag == "li":
            i = self._find_open(("li",), SCOPE_STOP | {"ul", "ol"})
            if i >= 0:
                self._close_through(i, at)
        elif tag in ("dt", "dd"):
            i = self._find_open(("dt", "dd"), SCOPE_STOP | {"dl"})
            if i >= 0:
                self._close_through(i, at)
        elif tag in ("option", "optgroup"):
            if self.stack and self.elems[self.stack[-1]]["tag"] == "option":
                self._close_top(at)
            if tag == "optgroup":
                i = self._find_open(("optgroup",), SCOPE_STOP | {"select"})
                if i >= 0:
                    self._close_through(i, at)
        elif tag == "tr":
            i = self._find_open(("tr",), {"table", "html"})
            if i >= 0:
                self._close_through(i, at)
        elif tag in ("td", "th"):
            i = self._find_open(("td", "th"), {"tr", "table", "html"})
            if i >= 0:
                self._close_through(i, at)
        elif tag == "body":
            i = self._find_open(("head",), {"html"})
            if i >= 0:
                self._close_through(i, at)

    def _open(self, tag: str, attrs, void: bool) -> None:
        at = self._offset()
        self._implied_ends(tag, at)
        raw = self.get_starttag_text() or ""
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        eid = len(self.elems)
        h0 = at + len(raw)
        e = {
            "eid": eid,
            "parent": self.stack[-1] if self.stack else -1,
            "tag": tag,
            "id": amap.get("id"),
            "classes": [c for c in amap.get("class", "").split() if c],
            "_amap": amap,
            "t0": len(self.texts),
            "t1": len(self.texts),
            "h0": h0,
            "h1": h0,
        }
        self.elems.append(e)
        if not void:
            self.stack.append(eid)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag, attrs):
        # a self-closing slash only means something on void elements
        self._open(tag, attrs, tag in VOID)

    def handle_endtag(self, tag):
        at = self._offset()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.elems[self.stack[i]]["tag"] == tag:
                self._close_through(i, at)
                return

    def handle_data(self, data):
        if data:
            self.texts.append(data)

    def finish(self) -> dict:
        self.close()
        self._close_through(0, len(self.src))
        return {"texts": self.texts, "elements": self.elems}


def parse_dom(html: str | None) -> dict | None:
    """Tokenize one page (pure Python; used inside the Arrow batch function)."""
    if html is None:
        return None
    b = _TreeBuilder(html)
    try:
        b.feed(html)
    except AssertionError:  # the parser's own limit on malformed markup: keep what was built so far
        b._close_through(0, len(html))
        return {"texts": b.texts, "elements": b.elems}
    return b.finish()
