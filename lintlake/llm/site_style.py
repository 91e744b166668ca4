"""Main text of web pages by site style trees.

Every page is parsed once into element nodes (tag, id and classes from the root down) and text blocks. The pages of one host are merged
by node: a node's presentation importance is the entropy of its child sequences over the host's pages, a text node's content importance
is one minus the mean entropy of its texts, and importance is composed bottom-up with damping ``DAMPING``. Branches under
``LEAST_IMPORTANCE`` are noise and leave every page of the host. Elements whose tag or role states what they are (menus, footers,
forms, scripts) leave before, so hosts with few pages are cleaned too; those whose class or id does (adverts, comments) leave with them if
they hold no article, main or h1 and, unless an article or main stands outside, under ``NAMED_SHARE`` of the page's text. Where names
would leave nothing, they do not count. Counting is by (host, node) with combined sums; only the merged templates of a host, nodes seen
on several pages, meet in one group.

Null html is an empty page with an empty text; a null or odd url belongs to the host ''; repeated pages count as pages; where noise would
leave nothing of a page, only the named elements leave; nodes deeper than ``MAX_DEPTH`` count as their ancestor there; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.frames import stash

DAMPING, LEAST_IMPORTANCE, MIN_PAGES, MAX_DEPTH = 0.9, 0.2, 5, 64
#: An element leaves for its class or id only with less than this share of its page's text; a wrapper of the article holds more.
NAMED_SHARE = 0.5

#: Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set(
    "aside audio button canvas dialog embed fieldset footer form head iframe input label map math menu nav noscript object option picture "
    "script select style svg template textarea title video".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended "
    "related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
ROOTS = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What no element leaves with for its name.
CORE = {"article", "main", "h1"}
#: A start tag (key) ends an open element of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
#: What such an element does not reach beyond.
SCOPES = {"ul", "ol", "dl", "table", "select", "html", "body", "article", "main", "section", "div"}

_SCHEMA = (
    "page_id long, url string, host string, blocks array<struct<nodes: array<long>, text: string>>, "
    "elements array<struct<node: long, parent: long, shape: long>>, texts array<struct<node: long, feature: long>>"
)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    __slots__ = ("tag", "node", "path", "dropped", "inside", "named", "children")

    def __init__(self, tag: str, node: int, path: tuple[int, ...], dropped: bool, inside: bool, named: tuple[int, ...]):
        self.tag, self.node, self.path, self.dropped, self.inside, self.named, self.children = tag, node, path, dropped, inside, named, []


class Page(HTMLParser):
    """``blocks``: (path of nodes, text) of the texts in page order; ``shapes``: node to (parent, its child sequences on this page)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple[int, ...], str]] = []
        self.shapes: dict[int, tuple[int, set]] = {}
        self.sizes: list[int] = []  # text of each element with a noise name
        self.core: set[int] = set()  # those with a part of CORE inside
        self.marked = False  # text of an article or main outside all elements with a noise name
        self.held: list[tuple[int, ...]] = []  # for each block the elements with a noise name around it
        self.stack = [Element("", 0, (), False, False, ())]
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.link: int | None = None  # size of the open link
        self.feed(html)
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        total = sum(len(t) for _, t in self.blocks)
        gone = {k for k, n in enumerate(self.sizes) if k not in self.core and (self.marked or n < NAMED_SHARE * total)}
        self.blocks = [b for b, named in zip(self.blocks, self.held, strict=True) if not gone.intersection(named)] or self.blocks

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        top = self.stack[-1]
        # outside the article a block that consists of links is a menu
        menu = self.linked >= 0.9 * self.size and not top.inside and top.tag != "p" and top.tag not in HEADINGS
        if text and not top.dropped and not menu:
            self.blocks.append((top.path, text))
            self.held.append(top.named)
            self.marked |= top.inside and not top.named
            for k in top.named:
                self.sizes[k] += len(text)
            top.children.append("#text")
        self.parts, self.linked, self.size, self.link = [], 0, 0, None

    def pop(self) -> None:
        done = self.stack.pop()
        if done.node != self.stack[-1].node:
            shape = tuple(c for k, c in enumerate(done.children) if not k or done.children[k - 1] != c)
            self.shapes.setdefault(done.node, (self.stack[-1].node, set()))[1].add(xxhash.xxh64_intdigest("\x00".join(shape)))

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "a":  # ends an open link
                self.linked += self.link or 0
                self.link = 0 if any(name == "href" for name, _ in attrs) else None
            return
        if tag == "br":
            self.parts.append(" ")
            return
        self.flush()
        if tag in VOID:
            return
        if tag not in INLINE and self.stack[-1].tag == "p":  # a block ends an open paragraph
            self.pop()
        ends = ENDS.get(tag)
        while ends and self.stack[-1].tag in ends:
            self.pop()
        top, given = self.stack[-1], dict(attrs)
        label = f"{tag}.{given.get('class') or ''}#{given.get('id') or ''}"
        node = top.node
        path = top.path
        if len(path) < MAX_DEPTH:
            node = xxhash.xxh64_intdigest(label, top.node) & 0x7FFFFFFFFFFFFFFF
            path = (*path, node)
        top.children.append(label)
        dropped, named = top.dropped or role_noise(tag, given, top.inside), top.named
        if tag in CORE and not dropped:
            self.core.update(named)
        if not dropped and named_noise(tag, given, top.inside):
            named = (*named, len(self.sizes))
            self.sizes.append(0)
        self.stack.append(Element(tag, node, path, dropped, top.inside or tag in ("article", "main"), named))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in INLINE:
            if tag == "a":
                self.linked, self.link = self.linked + (self.link or 0), None
            return
        self.flush()
        scoped = tag in ENDS or tag == "p"
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if scoped and self.stack[k].tag in SCOPES:
                return

    def handle_data(self, data):
        if not self.stack[-1].dropped:
            self.parts.append(data)
            n = len(data) - data.count(" ")
            self.size += n
            if self.link is not None:
                self.link += n


def role_noise(tag: str, attrs: dict, inside: bool) -> bool:
    """Whether an element's tag, role or visibility says that it is no main text. ``inside``: within an article, where a header is its own."""
    if tag in ROOTS:
        return False
    if tag in DROPPED or tag == "header" and not inside or (attrs.get("role") or "").lower() in ROLES:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")


def named_noise(tag: str, attrs: dict, inside: bool) -> bool:
    """Whether an element's class or id suggests that it is no main text."""
    if tag in ROOTS:
        return False
    words = {w.lower() for name in ("class", "id") for w in _NAME_PARTS.findall(attrs.get(name) or "")}
    return bool(words & NAMES) or "header" in words and not inside and tag in ("div", "section", "table")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _page_rows(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            pages = [Page(h or "") for h in part.column("html").to_pylist()]
            rows = {
                "host": [host_of(u) for u in part.column("url").to_pylist()],
                "blocks": [[{"nodes": path, "text": text} for path, text in p.blocks] for p in pages],
                "elements": [
                    [{"node": n, "parent": up, "shape": s - (1 << 63)} for n, (up, shapes) in p.shapes.items() for s in shapes] for p in pages
                ],
                "texts": [
                    [{"node": n, "feature": f - (1 << 63)} for n, f in {(path[-1] if path else 0, xxhash.xxh64_intdigest(t)) for path, t in p.blocks}]
                    for p in pages
                ],
            }
            pair = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64())]))
            kinds = {
                "host": pa.string(), "texts": pair,
                "blocks": pa.list_(pa.struct([("nodes", pa.list_(pa.int64())), ("text", pa.string())])),
                "elements": pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("shape", pa.int64())])),
            }
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), *(pa.array(v, kinds[k]) for k, v in rows.items())], ["page_id", "url", *rows]
            )


def importances(nodes: pd.DataFrame) -> dict[int, float]:
    """Composite importance of each node of one host. ``nodes``: node, parent, pages, shapes, presentation, content (null: no texts)."""
    by_parent: dict[int, list[int]] = {}
    for node, parent in zip(nodes["node"], nodes["parent"], strict=True):
        by_parent.setdefault(parent, []).append(node)
    at = {n: k for k, n in enumerate(nodes["node"])}
    pages, shapes, presentation, content = (nodes[c].tolist() for c in ("pages", "shapes", "presentation", "content"))
    order, todo = [], [n for n, p in zip(nodes["node"], nodes["parent"], strict=True) if p not in at]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += by_parent.get(n, [])
    out: dict[int, float] = {}
    for n in reversed(order):
        k = at[n]
        parts = [(out[c], pages[at[c]]) for c in by_parent.get(n, [])]
        if content[k] is not None and not math.isnan(content[k]):
            parts.append((content[k], pages[k]))
        below = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else 1.0
        damp = DAMPING ** shapes[k]
        out[n] = below if not by_parent.get(n) and parts else (1 - damp) * presentation[k] + damp * below
    return out


def _noise_of_host(nodes: pd.DataFrame) -> pd.DataFrame:
    low = [n for n, v in importances(nodes).items() if v < LEAST_IMPORTANCE]
    return pd.DataFrame({"host": [nodes["host"].iloc[0]], "noise": [low]})


def noisy_nodes(pages: DataFrame) -> DataFrame:
    """(host, noise): nodes of low importance, from parsed pages."""
    shape = pages.select("host", F.explode("elements").alias("e")).groupBy("host", "e.node", "e.parent", "e.shape").agg(F.count("*").alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    presented = shape.groupBy("host", "node", "parent").agg(
        F.sum("n").alias("seen"), F.count("*").alias("shapes"), entropy.alias("bits")
    )
    text = pages.select("host", F.explode("texts").alias("t")).groupBy("host", "t.node", "t.feature").agg(F.count("*").alias("n"))
    contents = text.groupBy("host", "node").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("spread"))
    # a node may show several shapes on one page, so its pages are counted apart
    where = pages.select("host", F.explode(F.array_distinct(F.transform("elements", lambda e: e["node"]))).alias("node"))
    counted = where.groupBy("host", "node").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    nodes = presented.join(counted, ["host", "node"]).join(contents, ["host", "node"], "left").select(
        "host", "node", "parent", "pages", "shapes",
        F.least(F.col("bits") / F.log("pages"), F.lit(1.0)).alias("presentation"),
        F.greatest(1 - F.col("spread") / F.log("pages"), F.lit(0.0)).alias("content"),
    )
    return nodes.groupBy("host").applyInPandas(_noise_of_host, "host string, noise array<long>").filter(F.size("noise") > 0)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    parsed = stash(pages.select("page_id", "url", "html").mapInArrow(_page_rows, _SCHEMA), "pages")
    noise = stash(noisy_nodes(parsed), "noise")  # a table of known size: where it is small, the pages are not shuffled
    joined = parsed.select("page_id", "url", "host", "blocks").join(noise, "host", "left")
    clean = F.filter("blocks", lambda b: ~F.exists(b["nodes"], lambda n: F.array_contains(F.col("noise"), n)))
    kept = F.when(F.col("noise").isNull() | (F.size(clean) == 0), F.col("blocks")).otherwise(clean)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
