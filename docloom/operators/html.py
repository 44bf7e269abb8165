"""HTML pages: fast column functions for single facts, and a tree for the main content."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What holds no content, where content is looked for first, where a date may stand; in order.
STRIP = (
    "script", "style", "noscript", "iframe", "svg", "nav", "header", "footer",
    ".sidebar", ".nav", ".menu", ".breadcrumb", ".social-share", ".cookie-notice", ".popup",
    "#sidebar", "#nav", "#footer",
)
CONTENT = (
    "article", "main", "[role='main']", ".entry-content", ".post-content", ".article-content", ".content-area", ".page-content",
    "#content", "#main-content", ".field-item", ".node-content", ".region-content",
)
DATE_METAS = ("article:published_time", "datePublished", "date", "DC.date")
DATE_CLASSES = ("date", "post-date", "publish-date", "entry-date")
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
_LINK = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "description", "date", "text")]
    + [T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(_LINK)), T.StructField("tables", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("char_count", "word_count")]
)


class Node:
    def __init__(self, tag: str, attrs: dict, parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def bare(self) -> str:
        """Its pieces of text, each stripped, without anything between them."""
        return "".join(c.strip() if isinstance(c, str) else c.bare() for c in self.children)

    def find(self, tag: str):
        return next((n for n in self.walk() if n.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None, emit_text_nodes: bool = False, least: int = 50) -> dict | None:
    """The facts and the main text of a page; None for a null page, one without a body, or one with under `least` characters of text.

    With `emit_text_nodes`, the text of blocks also comes again as bare text after
    each block, and list items stand on one line.
    """
    if html is None:
        return None
    builder = _Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    nodes = list(root.walk())
    by_property = _metas(nodes, "property")
    by_name = _metas(nodes, "name")

    def first(names, *tables) -> str:
        return next((t[n].strip() for n in names for t in tables if t.get(n)), "")

    title_node, h1, time = root.find("title"), root.find("h1"), root.find("time")
    title = first(("og:title",), by_property) or (title_node.bare() if title_node else h1.bare() if h1 else "")
    date = first(DATE_METAS, by_property, by_name)
    if not date and time is not None:
        date = time.attrs.get("datetime", time.bare())
    elif not date:
        dated = next((n for word in DATE_CLASSES for n in nodes if word in n.attrs.get("class", "").lower()), None)
        date = dated.bare()[:30] if dated else ""

    def strip(node: Node) -> None:
        node.children = [c for c in node.children if not (isinstance(c, Node) and _dropped(c))]
        for c in node.children:
            if isinstance(c, Node):
                strip(c)

    strip(root)
    content = _content(root)
    if content is None:
        return None
    text = _structured(content, emit_text_nodes)
    if len(text) < least:
        return None
    found = list(content.walk())
    return {
        "title": title, "description": first(("description", "og:description"), by_name, by_property), "date": date, "text": text,
        "headings": [n.bare() for n in found if n.tag in ("h1", "h2", "h3", "h4") and n.bare()],
        "links": [{"text": n.bare(), "href": n.attrs["href"]} for n in found if n.tag == "a" and "href" in n.attrs and n.bare()],
        "tables": [t for t in (_table(n) for n in found if n.tag == "table") if t],
        "char_count": len(text), "word_count": len(text.split()),
    }


def _metas(nodes: list[Node], key: str) -> dict[str, str]:
    """The content of the first meta tag of each name."""
    out: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta" and n.attrs.get(key):
            out.setdefault(n.attrs[key], n.attrs.get("content", ""))
    return out


def _is(n: Node, selector: str) -> bool:
    if selector.startswith("."):
        return selector[1:] in n.attrs.get("class", "").split()
    if selector.startswith("#"):
        return n.attrs.get("id") == selector[1:]
    if selector.startswith("["):
        return n.attrs.get("role") == "main"
    return n.tag == selector


def _dropped(n: Node) -> bool:
    return any(_is(n, s) for s in STRIP)


def _content(root: Node) -> Node | None:
    """Of the first selector with a hit the longest element, else the `div` with most text in paragraphs, else the body."""
    nodes = list(root.walk())
    for selector in CONTENT:
        hits = [n for n in nodes if _is(n, selector)]
        if hits:
            return max(hits, key=lambda n: len(n.text()))
    divs = [(sum(len(p.text()) for p in n.walk() if p.tag == "p"), n) for n in nodes if n.tag == "div"]
    most = max(divs, key=lambda x: x[0], default=(0, None))
    return most[1] if most[0] > 200 else root.find("body")


def _structured(node: Node, emit: bool) -> str:
    parts: list[str] = []

    def visit(n: Node, inside: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip() and (emit or not inside):
                    parts.append(c.strip())
                continue
            t = c.bare()
            block = True
            if re.fullmatch("h[1-6]", c.tag) and t:
                parts.append(f"\n\n## {t}\n")
            elif c.tag == "p" and t:
                parts.append(f"\n{t}\n")
            elif c.tag == "li" and t:
                parts.append(f"  - {t}" if emit else f"\n  - {t}")
            elif c.tag == "br":
                parts.append("\n")
            else:
                block = False
            visit(c, inside or block)

    visit(node, False)
    return re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", " ".join(parts))).strip()


def _table(node: Node) -> str:
    rows = []
    for tr in (n for n in node.walk() if n.tag == "tr"):
        cells = [c.bare() for c in tr.walk() if c.tag in ("td", "th")]
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


@F.pandas_udf(SCHEMA)
def html_extract(pages: pd.Series) -> pd.DataFrame:
    """`parse` for a column of pages; pages without text give a struct of nulls."""
    empty = dict.fromkeys(("title", "description", "date", "text", "headings", "links", "tables", "char_count", "word_count"))
    return pd.DataFrame([parse(p) or empty for p in pages], columns=list(empty))


def title(html: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]+og:title"[^>]+content="([^"]*)"', 1), F.lit("")),
        F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")),
        F.nullif(F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")),
        F.lit(""),
    )


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))
