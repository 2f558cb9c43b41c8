"""Main-text extraction with site template removal.

A page is parsed into a tree whose block elements get a hash of their subtree (tag, text and children, not
attributes). Spark counts on how many pages of a host each hash occurs, pages with equal main containers once; a subtree that recurs across many
pages of its host is template and is deleted. What "many" is depends on the kind, because articles quote
and copy each other: for running text (paragraphs, headings, list items), more than `main_share` of the host's pages and
at least `main_pages`; for other containers `outside_share` and `outside_pages`. If such containers hold more than half
of a named main container, the page is a near copy of others and keeps them.
Elements that are boilerplate by kind (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments; by tag, role, class or id) are dropped on any page. The main container is
every outermost article or main in page order, else every outermost container named as content, else the body
without link lists.

Only subtrees inside the main container, where the page names one, are counted. What a page must lose is
sent to every task while it is small (its size is checked), else joined by a shuffle.
The page key of the joins is a hash of the whole row, so page ids may be null or repeated. A host holding a
third of all pages adds rows, not groups: counting is pre-aggregated, the join back is on (host, subtree)
and split by AQE, and no task gathers a host.

Defined results: null html is empty; a page without text gives an empty string; a null url is host ''; broken
markup is read leniently, unknown references stay as written; repeated rows count once and are returned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches, ddl, record_batch
from logloom.session import checkpoint

BROADCAST_BYTES = 8 << 20

SUBTREES = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("host", pa.int64()), ("subtrees", pa.list_(pa.int64()))])
SUBTREES_DDL = "key long, content long, host long, subtrees array<long>"
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

#: Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "figcaption", "caption"}
DROPPED = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "menu", "dialog", "audio", "video", "map", "fieldset", "datalist", "applet", "noembed", "noframes"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note", "status"}
DROPPED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie",
    "cookies", "copyright", "disqus", "dropdown", "footer", "form", "gdpr", "hidden", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}
MAIN_NAMES = {"article", "content", "post", "entry", "story", "main", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

#: Word parts that mark boilerplate inside a longer name, such as `cookiebar`.
DROPPED_PARTS = re.compile("cookie|advert|sidebar|sidenav|newsletter|breadcrumb|disqus|navbar|popup|usercomment|readercomment", re.I)

ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
STOPS = re.compile(r"""[<>"']""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/><\"']*")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "attributes", "children", "subtree", "size")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.subtree, self.size = tag, attributes, [], 0, None

    def names(self) -> tuple[set[str], dict[str, str]]:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.attributes)} if self.attributes else {}
        words = NAME.findall(f"{found.get('class', '')} {found.get('id', '')}") if found else []
        return {w.lower() for w in words}, found


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, text or name, attributes) from left to right: kinds are text, open, close.

    Every character is looked at a bounded number of times: a tag that meets a `<` outside its quotes before
    its `>` is text up to there, a quote that never closes is no quote, and a tag cut off by the end is dropped.
    """
    n, at = len(html), 0
    last = {c: html.rfind(c) for c in "\"'>"}
    raw = {}
    while at < n:
        start = html.find("<", at)
        if start < 0:
            yield "text", html[at:], ""
            return
        if start > at:
            yield "text", html[at:start], ""
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start) and start < last[">"]:
            at = html.find(">", start) + 1
            continue
        closing = html.startswith("/", start + 1)
        m = TAG_NAME.match(html, start + 1 + closing)
        if m is None:
            yield "text", "<", ""
            at = start + 1
            continue
        end = m.end()
        while True:
            stop = STOPS.search(html, end)
            if stop is None or stop[0] in "<>":
                break
            # a quote
            end = html.find(stop[0], stop.end()) + 1 if stop.end() <= last[stop[0]] else stop.end()
        if stop is None:
            return
        if stop[0] == "<":
            yield "text", html[start : stop.start()], ""
            at = stop.start()
            continue
        at, name, attributes = stop.end(), m[0].lower(), html[m.end() : stop.start()]
        yield ("close" if closing else "open"), name, attributes
        if not closing and name in RAW:
            if name not in raw:
                raw[name] = re.compile(rf"</{name}\s*>", re.I)
            found = raw[name].search(html, at)
            at = found.end() if found else n


def parse(html: str) -> Node:
    root = Node("#root")
    stack = [root]
    open_ = Counter()

    def close(depth: int) -> None:
        open_.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    for kind, text, attributes in tags(html):
        if kind == "text":
            stack[-1].children.append(text)
        elif kind == "close":
            if open_[text]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == text))
        else:
            if text not in INLINE and text not in VOID and any(open_[t] for t in CLOSES.get(text, ("p",))):
                depth = _implied(stack, text)
                if depth:
                    close(depth)
            node = Node(text, attributes)
            stack[-1].children.append(node)
            if text not in VOID and text not in RAW and not attributes.endswith("/"):
                stack.append(node)
                open_[text] += 1
    return root


def _implied(stack: list[Node], tag: str) -> int:
    """The depth of the element that an opening tag closes, 0 for none."""
    for depth in range(len(stack) - 1, 0, -1):
        open_ = stack[depth].tag
        if open_ in SCOPES.get(tag, ()) or open_ in ("table", "article", "section", "div", "td") and tag not in CLOSES:
            return 0
        if open_ == "p" and tag not in CLOSES or open_ in CLOSES.get(tag, ()):
            return depth
    return 0


def hash_subtrees(root: Node) -> list[Node]:
    """Sets the hash of every element below root; returns the block elements with text, outermost last."""
    blocks, order = [], [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        parts, filled = [node.tag], False
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"\x01{c.subtree}")
                filled |= c.subtree != 0
            elif text := " ".join(c.split()):
                parts.append(text)
                filled = True
        node.subtree = xxhash.xxh64_intdigest("\x02".join(parts)) - (1 << 63) if filled else 0
        if filled and node.tag not in INLINE and node.tag not in DROPPED:
            blocks.append(node)
    return blocks


def boilerplate(node: Node, inside_main: bool) -> bool:
    if node.tag in DROPPED or node.tag == "header" and not inside_main:
        return True
    if not node.attributes or node.tag in ("#root", "html", "body"):
        return False
    names, found = node.names()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in DROPPED_ROLES:
        return True
    if node.tag in ("article", "main") and not names & {"comment", "comments", "teaser", "ad", "ads", "advert", "related", "sponsored", "promo"}:
        return False
    own = f"{found.get('class', '')} {found.get('id', '')}"
    return bool(names & DROPPED_NAMES) or DROPPED_PARTS.search(own) is not None or "header" in names and not inside_main and not names & MAIN_NAMES


def _size(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if not boilerplate(c, True):
                    stack.append(c)
            else:
                total += len(c)
    return total


def main_container(root: Node) -> tuple[Node, bool]:
    """The container of the main text, and whether the page names it; several are put under one node in page order."""
    main: list[Node] = []
    named: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is not root:
            if node.tag in INLINE or boilerplate(node, False):
                continue
            names, attributes = node.names()
            if node.tag in ("article", "main") or attributes.get("role") == "main":
                main.append(node)
                continue
            if not inside and (attributes.get("itemprop") == "articleBody" or node.tag in ("div", "section", "td") and names & MAIN_NAMES):
                named.append(node)
                inside = True
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    found = main or named
    if len(found) < 2:
        return (found[0], True) if found else (root, False)
    together = Node("#main")
    together.children.extend(found)
    return together, True


def _measure(root: Node) -> None:
    """Sets on every element the characters of its text, and of those inside links."""
    order = [(root, False)]
    for node, link in order:
        order.extend((c, link or c.tag == "a") for c in node.children if isinstance(c, Node))
    for node, link in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [c.size for c in node.children if isinstance(c, Node)]
        node.size = (own + sum(t for t, _ in inner), own * link + sum(k for _, k in inner))


def _recurring(main: Node, loose: frozenset[int] | set[int]) -> set[int]:
    """The subtrees of containers inside a named main container that recur, unless they are most of its text."""
    found, total, stack = set(), 0, [main]
    while stack:
        for c in stack.pop().children:
            if not isinstance(c, Node) or boilerplate(c, True):
                continue
            if c.subtree and c.subtree in loose and c.tag not in INLINE and c.tag not in RUNNING:
                found.add(c.subtree)
                total += _size(c)
            else:
                stack.append(c)
    return found if found and 2 * total <= _size(main) else set()


def main_text(html: str, strict: frozenset[int] | set[int] = frozenset(), loose: frozenset[int] | set[int] = frozenset()) -> str:
    """strict: subtrees that are template anywhere; loose: template as containers."""
    root = parse(html)
    if strict or loose:
        hash_subtrees(root)
    main, named = main_container(root)
    boxes = _recurring(main, loose) if named and loose else set()
    if not named:
        _measure(main)
    blocks: list[list[str]] = [[]]

    # depth first without recursion: an int closes a block
    stack: list = [main]
    while stack:
        node = stack.pop()
        if node is None:
            blocks.append([])
            continue
        if isinstance(node, str):
            blocks[-1].append(node)
            continue
        if node.tag == "br" or node.tag == "hr":
            blocks[-1].append(" ")
            continue
        if node is not main:
            if boilerplate(node, named) or node.subtree and (node.subtree in strict or node.subtree in boxes and node.tag not in INLINE and node.tag not in RUNNING):
                continue
            if not named and node.tag not in INLINE and node.tag not in RUNNING and node.tag not in ("html", "body"):
                total, linked = node.size
                if node.subtree in loose and node.subtree or total and linked > 0.6 * total:
                    continue
        if node.tag in INLINE:
            stack.extend(reversed(node.children))
        else:
            blocks.append([])
            stack.append(None)
            stack.extend(reversed(node.children))
    texts = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(t for t in texts if t)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, 500):
        rows = []
        for key, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
            host = xxhash.xxh64_intdigest(host_of(url)) - (1 << 63)
            # of a page that names its main container, only what lies inside can matter
            main = main_container(parse(html))[0]
            blocks = hash_subtrees(main)
            # the leading 0 stands for the page itself
            rows.append((key, main.subtree, host, [0, *{n.subtree for n in blocks if n is not main}]))
        if rows:
            yield record_batch(SUBTREES, list(zip(*rows, strict=True)))


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, 500):
        rows = []
        for page_id, url, html, strict, loose in zip(*(c.to_pylist() for c in part.columns), strict=True):
            text = main_text(html, set(strict or ()), set(loose or ()))
            rows.append((page_id, url, text, len(text)))
        if rows:
            yield record_batch(TEXTS, list(zip(*rows, strict=True)))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", main_share: float = 0.6, main_pages: int = 10, outside_share: float = 0.02, outside_pages: int = 3
) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")
    # a few numbers a page, written once, so that pages are parsed once for counting and once for their text
    seen = checkpoint(rows.select("key", "url", "html").mapInArrow(_subtrees, SUBTREES_DDL)).select("key", "content", "host", F.explode("subtrees").alias("subtree"))
    # copies of a page are one content, whatever stands around their main container
    counted = seen.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    hosts = counted.where("subtree = 0").select(F.col("host").alias("host_"), F.col("n").alias("pages"))
    many = counted.where(F.col("subtree") != 0).where(F.col("n") >= min(main_pages, outside_pages)).join(hosts, F.col("host") == F.col("host_"))
    template = many.select(
        F.col("host").alias("h"),
        F.col("subtree").alias("s"),
        ((F.col("n") >= main_pages) & (F.col("n") > main_share * F.col("pages"))).alias("strict"),
        ((F.col("n") >= outside_pages) & (F.col("n") > outside_share * F.col("pages"))).alias("loose"),
    ).where("strict or loose")
    met = seen.join(template, (F.col("host") == F.col("h")) & (F.col("subtree") == F.col("s")))
    by_page = met.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.when(F.col("strict"), F.col("s"))).alias("strict"), F.collect_set(F.when(F.col("loose"), F.col("s"))).alias("loose"))
    by_page = checkpoint(by_page)
    size = by_page.agg(F.count("*").alias("rows"), F.sum(F.size("strict") + F.size("loose")).alias("ids")).first()
    # the pages are shuffled only if what they must learn is too much to send to every task
    small = 40 * size["rows"] + 8 * (size["ids"] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(by_page) if small else by_page, F.col("key") == F.col("k"), "left")
    return joined.select("page_id", "url", "html", "strict", "loose").mapInArrow(_extract, ddl(TEXTS))
