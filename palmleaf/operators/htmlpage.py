"""Pages: a tolerant event parser for blocks, typed content, links and images."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.session import spread

# Elements that end a block of text, and elements whose text is none.
BLOCK_TAGS = frozenset("p div section article blockquote li pre td th h1 h2 h3 h4 h5 h6 figcaption dd dt".split())
SILENT_TAGS = frozenset("script style template noscript svg canvas".split())
_KIND = {**{f"h{i}": "heading" for i in range(1, 7)}, "blockquote": "quote", "pre": "code", "li": "list", "td": "table", "th": "table"}
_NO_LINK = ("#", "mailto:", "tel:", "javascript:", "data:")


class _Story(HTMLParser):
    """Blocks inside articles (or the whole body without one), the title, links and images."""

    def __init__(self, article_only: bool):
        super().__init__(convert_charrefs=True)
        self.inside_only = article_only
        self.depth = self.silent = 0
        self.blocks: list[tuple[str, str]] = []
        self.buffer: list[str] = []
        self.title: list[str] = []
        self.in_title = False
        self.kind: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.anchor: list | None = None
        self.images: list[str] = []
        self.base = ""
        self.tables: list[list[list[str]]] = []
        self.lists: list[list[str]] = []
        self.open: list[tuple[str, list]] = []  # tables and lists around the current place
        self.cell: list[str] | None = None

    def _close_cell(self) -> None:
        """The text since the last cell or item began becomes its content."""
        if self.cell is not None and self.open:
            kind, rows = self.open[-1]
            text = " ".join(self.cell)
            if kind == "table" and rows:
                rows[-1].append(text)
            elif kind != "table" and text:
                rows.append(text)
        self.cell = None

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text and self.cell is not None:
            self.cell.append(text)
        if text:
            self.blocks.append((_KIND.get(self.kind[-1], "paragraph") if self.kind else "paragraph", text))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "base":
            self.base = a.get("href") or ""
        elif tag == "a" and a.get("href") and "nofollow" not in (a.get("rel") or "").lower():
            self.anchor = [a["href"].strip(), []]
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or a.get("data-lazy-src")
            if src and src not in self.images:
                self.images.append(src)
        if tag == "br" or tag in BLOCK_TAGS:
            self._flush()
        if tag in ("table", "ul", "ol"):
            self.open.append((tag, []))
            (self.tables if tag == "table" else self.lists).append(self.open[-1][1])
        elif tag == "tr" and self.open and self.open[-1][0] == "table":
            self.open[-1][1].append([])
        elif tag in ("td", "th", "li"):
            self._close_cell()
            self.cell = []
        if tag in BLOCK_TAGS:
            self.kind.append(tag)
        if tag == "article":
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None
        if tag in BLOCK_TAGS:
            self._flush()
        if tag in ("td", "th", "li", "tr", "table", "ul", "ol"):
            self._close_cell()
        if tag in ("table", "ul", "ol") and any(k == tag for k, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCK_TAGS:
            if tag in self.kind:
                while self.kind.pop() != tag:
                    pass
        if tag == "article":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            if self.anchor:
                self.anchor[1].append(data)
            if self.depth or not self.inside_only:
                self.buffer.append(data)


def story(page: str, article_only: bool | None = None) -> tuple[str, list[tuple[str, str]], _Story]:
    """(title, [(kind, text)], parser) of a page; without ``article_only`` articles decide where there are any."""
    inside = "<article" in page.lower() if article_only is None else article_only
    p = _Story(inside)
    p.feed(page)
    p.close()
    p._flush()
    title = " ".join("".join(p.title).split())
    blocks = p.blocks
    if blocks and blocks[0][1].casefold() == title.casefold():
        blocks = blocks[1:]
    return title, blocks, p


_PAGE = "page_id long, title string, blocks array<struct<kind string, text string>>, links array<struct<url string, text string>>, images array<string>, tables array<array<array<string>>>, lists array<array<string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, title, blocks, links, images, tables, lists) of each page; links are absolute and distinct.

    A table is its rows of cells without the rows that are all empty, a list its items; a table or list within a cell or item stands by itself.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, page in zip(b["page_id"], b["url"], b["html"]):
                title, blocks, p = story(page)
                found = {}
                for href, text in p.links:
                    if href and not href.lower().startswith(_NO_LINK):
                        try:
                            found.setdefault((urljoin(urljoin((url or "").strip(), p.base), href), text))
                        except ValueError:
                            continue
                rows.append((i, title, [{"kind": k, "text": t} for k, t in blocks], [{"url": u, "text": t} for u, t in found], p.images, [[r for r in t if any(r)] for t in p.tables], p.lists))
            yield pd.DataFrame(rows, columns=["page_id", "title", "blocks", "links", "images", "tables", "lists"])

    return spread(pages.where("html is not null").select("page_id", "url", "html")).mapInPandas(work, _PAGE)


def block_statistics(done: DataFrame) -> DataFrame:
    """(page_id, n_blocks, n_chars, n_words, n_links, n_images, kinds): kinds counts blocks by kind, as text."""
    kinds = F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["kind"])))
    hist = F.transform(kinds, lambda k: F.concat(k, F.lit("="), F.size(F.filter("blocks", lambda b: b["kind"] == k)).cast("string")))
    total = lambda f: F.aggregate(F.transform("blocks", f), F.lit(0), lambda a, x: a + x).cast("long")
    return done.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), total(lambda b: F.length(b["text"])).alias("n_chars"), total(lambda b: F.size(F.split(b["text"], " "))).alias("n_words"), F.size("links").cast("long").alias("n_links"), F.size("images").cast("long").alias("n_images"), F.array_join(hist, ",").alias("kinds"))


def markdown(done: DataFrame) -> DataFrame:
    """(page_id, markdown): headings with ``#``, quotes with ``>``, list entries with ``-``."""
    mark = lambda b: F.concat(F.when(b["kind"] == "heading", "## ").when(b["kind"] == "quote", "> ").when(b["kind"] == "list", "- ").otherwise(""), b["text"])
    return done.select("page_id", F.array_join(F.concat(F.array(F.concat(F.lit("# "), "title")), F.transform("blocks", mark)), "\n\n").alias("markdown"))


def article_html(done: DataFrame) -> DataFrame:
    """(page_id, article): one element per block, escaped."""
    from palmleaf.functions.text import escape_html

    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<p>"), escape_html(b["text"]), F.lit("</p>"))), "\n")
    return done.select("page_id", F.concat(F.lit("<article>\n<h1>"), escape_html(F.col("title")), F.lit("</h1>\n"), body, F.lit("\n</article>")).alias("article"))


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): title, else first heading, else the url; by expressions of the JVM."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))
    t = clean(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    h = clean(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return pages.where("html is not null").select("page_id", F.coalesce(F.nullif(t, F.lit("")), F.nullif(h, F.lit("")), F.coalesce("url", F.lit(""))).alias("title"))


def quality_score(done: DataFrame) -> DataFrame:
    """(page_id, score): four points a word and one per hundred characters up to 20,000."""
    s = block_statistics(done)
    return s.select("page_id", F.round(4 * F.col("n_words") + F.least("n_chars", F.lit(20_000)) / 100, 2).alias("score"))


# Marks of a page that checks its visitor.
CHALLENGES = ("just a moment", "checking your browser", "verify you are human", "challenges.cloudflare.com", "cf-chl-")


def is_challenge(title: Column, page: Column) -> Column:
    """Whether a title or the first 25,000 characters of a page (the rule's definition) hold a mark of a check."""
    low = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(page, F.lit(25_000))))
    hit = low.contains(CHALLENGES[0])
    for mark in CHALLENGES[1:]:
        hit = hit | low.contains(mark)
    return hit
