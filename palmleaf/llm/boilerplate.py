"""Page boilerplate: which lines of a story's text belong to the site and not to the story.

Method: site style tree. The pages of one host are parsed and merged. An element node is a path of
tags with the kinds of children that it has; its presentations are the exact sequences of children
with which it occurs; its leaves are blocks of text with their normalised contents. No word list takes part:
importance is entropy, counted from the data.

* Leaf (content): 1 - log(k) / log(m), where its content stands in k of the m stories of the host: the
  entropy of an even spread over k stories, normalised by the largest possible one. The
  same is counted over all hosts with the site's name masked, and the smaller value holds. Stories
  are told apart by title, so reprints of a story under many urls count once.
* Node (presentation): the entropy of its presentations, normalised alike. Furniture is built in the
  same way on every page, the body of a story never is.
* Composite of a node: (1 - GAMMA^l) x presentation + GAMMA^l x content, where content is the mean
  importance of the leaves below it, weighted by length, and l its mean number of children.

A node's weight is the text that it carries per page times its composite importance. The branches of a node that
weighs less than BRANCH_SHARE of the host's heaviest one are removed from each page, unless it holds most of the
important text of a page and that much. An ancestor weighs no less than its descendants, so a branch falls exactly if
it or a node above it is light. On the branches that stay, leaves of low importance go, except what
stories share by nature: titles, bylines, notes, breaks, speech, and leaves too short to be told by their content
(refrains, headings).

A text is then read line by line against the leaves of its page. A line that no leaf of its page
equals, and every line of a row without a page, goes by what the trees learned: it is furniture if
a short line has a part (between bars, colons, brackets, wide gaps) that recurs over stories and stands on removed
branches more often than on kept ones, or if its content is of low importance. In rows
without a page the places of the lines around the story decide on the rest.

Scale: pages are cut into leaves where they are read; only hashes and counts are shuffled, and every count is over
(content, story) pairs made distinct before, so a line that stands in a third of all rows is spread by
its stories. No host is ever gathered in one task. A row's lines are gathered per row.

Nulls: rows without text have no lines. A missing source_host is read off the url; a missing title is replaced by
the url. Pages without a hash or file belong to no row. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.words import NOT_LETTER
from palmleaf.session import spread

#: A node stays if it weighs this share of the heaviest one of its host.
BRANCH_SHARE = 0.3
#: Damping of a node's own presentation against the contents below it.
GAMMA = 0.9
#: A leaf under this importance has low importance; it must also recur in so many stories.
LEAF_IMPORTANCE, MIN_STORIES = 0.7, 4
#: A leaf of fewer letters is too short to be told by its content on a kept branch.
MIN_CONTENT = 20
#: A line of so many characters is a paragraph; shorter ones are also told by their parts.
LONG = 90

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<!--.*?-->", re.S)
_VOID = frozenset("br img hr meta link input wbr area base col source".split())
_SKIP = frozenset("script style template noscript svg canvas title".split())
_INNER = frozenset("p span a b i em strong h1 h2 h3 h4 h5 h6 u small".split())
_BLOCK = frozenset("div section article aside nav header footer main table ul ol form".split())

# What stories share by nature.
_BREAK = re.compile(r"[\W_]*$|(?:chapter|part|episode|భాగం|అధ్యాయం|अध्याय|भाग)?\s*[\divxlc]{1,6}\s*[.):]?\s*$", re.I)
_BYLINE = re.compile(r"\W*(?:by\s+\S|written by|author\s*[-:–]|story and words|story\s*[-:]|words by|రచన|రచయిత\s*[-:]|లేఖ|लेखक|kathaa?\s*[-:]|rachana)", re.I)
_NOTE = re.compile(r"\W*(?:author'?s? note|note from the author|a note|dedicated to|for my|రచయిత మాట)", re.I)
_SPEECH = re.compile("\\s*[\"“‘]")
_PARTS = re.compile(r"[|/·•»«›>:,;()\[\]]+|\s{2,}|\s[-–—]\s|\.\.\.")


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def site_name(host: str) -> str:
    """The site's name in its host: the words of the first label that hold no digit."""
    label = host.split(".", 1)[0] if not host.startswith("www.") else host.split(".", 2)[1]
    return " ".join(w for w in label.split("-") if w and not any(c.isdigit() for c in w))


def flat(text: str) -> str:
    """Single blanks, none at the ends: how a leaf and a line are compared."""
    return " ".join(text.split())


@lru_cache(20_000)
def _name(s: str) -> int:
    """The hash of a node or presentation, remembered because they recur."""
    return _hash(s)


_ASCII_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def _letters(text: str) -> str:
    low = text.lower()
    if low.isascii():  # the same, at the speed of bytes
        return b" ".join(low.encode("ascii").translate(_ASCII_LETTERS).split()).decode("ascii")
    return " ".join(NOT_LETTER.sub(" ", low).split())


def content(text: str, site: str) -> str:
    """A leaf's normalised content: letters only, lower case, the site's name masked."""
    low = _letters(text)
    return low.replace(site, "§") if site else low


def parts(text: str, masked: str) -> list[int]:
    """Hashes of the masked content of a line and, if it is short, of its parts."""
    out = {masked}
    if len(text) < LONG:
        out.update(_letters(x) for x in _PARTS.split(text))
    out.discard("")
    return sorted(map(_hash, out))


def leaves(page: str) -> list[tuple[str, str, int, str, int]]:
    """(node, text, branch, presentation, children) of each block of text of a page, in order.

    Tolerant: a closing tag without its opening one is ignored, an open element
    ends with its parent. A block of text belongs to the first element around it that isn't
    inline, its branch; where that one holds blocks too, the inline element is the branch. The node is the branch's path of tags with the kinds of its children, the presentation
    their exact sequence.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kids: dict[int, list] = {0: []}
    paths: dict[int, str] = {0: ""}
    up: dict[int, int] = {0: 0}
    skip, number, current = "", 0, 0
    cut = _TAG.split(page)  # text, slash, name, text, ...
    for t, closing, name in zip(cut[::3], cut[1::3], cut[2::3]):
        if t and not skip and not t.isspace():
            out.append((current, t))
            kids[current].append("#")
        if name is None:
            continue
        name = name.lower()
        if closing:
            if skip:
                skip = "" if name == skip else skip
            elif stack and stack[-1][0] == name:
                stack.pop()
                current = stack[-1][1] if stack else 0
            elif any(x == name for x, _ in stack):
                while stack.pop()[0] != name:
                    pass
                current = stack[-1][1] if stack else 0
        elif not skip:
            kids[current].append(name)
            if name in _SKIP:
                skip = name
            elif name not in _VOID:
                number += 1
                paths[number] = f"{paths[current]}/{name}"
                up[number] = current
                stack.append((name, number))
                current = number
                kids[number] = []
    t = cut[-1]
    if not skip and t.strip():
        out.append((current, t))
        kids[current].append("#")
    res = []
    at: dict[int, tuple[str, int, str, int]] = {}
    for e, t in out:
        text = flat(html.unescape(t) if "&" in t else t)
        if text and e in at:
            node, b, shape, n = at[e]
            res.append((node, text, b, shape, n))
        elif text:
            b = child = e
            while b and paths[b].rsplit("/", 1)[1] in _INNER:
                b, child = up[b], b
            if not _BLOCK.isdisjoint(kids[b]):  # beside other blocks an inline element is a branch of its own
                b = child
            at[e] = node, b, shape, n = f"{paths[b]}[{','.join(sorted(set(kids[b])))}]", b, ",".join(kids[b]), len(kids[b])
            res.append((node, text, b, shape, n))
    return res


def _host(url: str | None, host: str | None = None) -> str:
    if host:
        return host.lower()
    m = re.match(r"\s*[a-zA-Z][\w+.\-]*://([^/?#:]+)", url or "")
    return m.group(1).lower() if m else ""


def page_key() -> Column:
    """The 64-bit key of a page; NULL without a file or hash."""
    return F.when((F.col("raw_file") != "") & (F.col("raw_sha256") != ""), F.xxhash64("raw_file", "raw_sha256"))


_LEAF = "page long, host long, title long, node long, shape long, children int, branch int, line long, leaf long, site_leaf long, size int, parts array<long>"
_LINE = "story_id long, page long, host long, title long, line_no long, line long, leaf long, site_leaf long, bits int, parts array<long>"
_ARROW = {"long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of the schema."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    arrays = []
    for kind, col in zip(kinds, zip(*rows) if rows else [()] * len(names)):
        if kind in _ARROW:
            arrays.append(pa.array(col, _ARROW[kind]))
        else:
            ends = np.cumsum([0, *map(len, col)], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(col)), pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def parsed(pages: DataFrame) -> DataFrame:
    """One row per leaf of a page, as hashes: (page, host, title, node, shape, children, branch, line, leaf, site_leaf, size, parts)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, url, page in zip(*(b[c].to_pylist() for c in ("page", "url", "html"))):
                host = _host(url)
                site = site_name(host)
                m = re.search(r"<title[^>]*>(.*?)</title>", page, re.S | re.I)
                th, hh = _hash(flat(html.unescape(m.group(1))) if m else url or ""), _hash(host)
                for node, text, branch, shape, n in leaves(page):
                    line, leaf, site_leaf, ps, _, _ = (_short if len(text) < LONG else _told)(text, site, host, False)
                    rows.append((key, hh, th, _name(node), _name(shape), n, branch, line, leaf, site_leaf, len(text), ps))
            yield _batch(rows, _LEAF)

    rows = pages.where("html is not null").select(page_key().alias("page"), "url", "html").where("page is not null")
    return spread(rows).mapInArrow(cut, _LEAF)


# Bits of what the text of a line says.
TITLE, BREAK, BYLINE, SPEECH, LONG_LINE, ENDED, TELLING = (1 << i for i in range(7))
_OWN = TITLE | BREAK | BYLINE | SPEECH


def line_bits(text: str, title: str, masked: str) -> int:
    bits = 0
    if title and text == title:
        bits |= TITLE
    if _BREAK.match(text):
        bits |= BREAK
    if _BYLINE.match(text) or _NOTE.match(text):
        bits |= BYLINE
    if _SPEECH.match(text):
        bits |= SPEECH
    if len(text) >= LONG:
        bits |= LONG_LINE
    if text[-1:] in ".!?…।\"”'’":
        bits |= ENDED
    if len(masked) - masked.count(" ") >= MIN_CONTENT:
        bits |= TELLING
    return bits


def _told(raw: str, site: str, host: str, bits: bool = True) -> tuple[int, int, int, list[int], int, str]:
    """What a text says by itself: (line, leaf, site_leaf, parts, bits but the title's, its flat form)."""
    text = flat(raw)
    c = content(text, site)
    site_leaf = _hash(c)
    ps = parts(raw, c) if len(raw) < LONG else [site_leaf] if c else []
    return _hash(text), _hash(host + "|" + c), site_leaf, ps, line_bits(text, "", c) if bits else 0, text


@lru_cache(20_000)
def _short(raw: str, site: str, host: str, bits: bool = True) -> tuple[int, int, int, list[int], int, str]:
    """The same, remembered because short texts recur; the memory is bounded."""
    return _told(raw, site, host, bits)


def story_lines(stories: DataFrame) -> DataFrame:
    """One row per line that is not blank: (story_id, page, host, title, line_no, line, leaf, site_leaf, bits, parts); page 0 means none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, page, url, host, title, text in zip(*(b[c].to_pylist() for c in ("story_id", "page", "url", "source_host", "title", "original_text"))):
                host = _host(url, host)
                site, title, no = site_name(host), flat(title or ""), 0
                hh, th = _hash(host), _hash(title or url or "")
                for x in text.split("\n"):
                    x = x.strip()
                    if not x:
                        continue
                    no += 1
                    line, leaf, site_leaf, ps, bits, t = (_short if len(x) < LONG else _told)(x, site, host)
                    rows.append((i, page, hh, th, no, line, leaf, site_leaf, bits | TITLE if title and t == title else bits, ps))
            yield _batch(rows, _LINE)

    rows = stories.where("story_id is not null and original_text is not null and original_text <> ''")
    # never NULL: page 0 means none
    rows = rows.select("story_id", F.coalesce(page_key(), F.lit(0).cast("long")).alias("page"), "url", "source_host", "title", "original_text")
    return spread(rows).mapInArrow(cut, _LINE)


def _low(k: str, m: str) -> Column:
    """The importance of a content in k of m stories: 1 where nothing is known of it."""
    return F.coalesce(1 - F.log(F.col(k)) / F.log(F.greatest(F.col(m), F.col(k), F.lit(2))), F.lit(1.0))


def content_counts(cut: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(recurring contents (id, k), stories per host (host, m), stories of all hosts).

    The lines of the texts count as leaves too, for some furniture stands only there.
    """
    from palmleaf.session import stage

    both = cut.select("host", "title", "leaf", "site_leaf").unionByName(lines.select("host", "title", "leaf", "site_leaf"))
    ids = both.select(F.explode(F.array("leaf", "site_leaf")).alias("id"), "title").distinct()
    k = stage(ids.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where(f"k >= {MIN_STORIES}"), "recurring")
    titles = stage(both.select("host", "title").distinct(), "titles")
    return k, titles.groupBy("host").agg(F.count(F.lit(1)).alias("m")), titles.select("title").distinct().count()


def _importance(rows: DataFrame, k: DataFrame, m: DataFrame, total: int) -> DataFrame:
    """``rows`` with the importance of their leaf within its host and over all hosts."""
    rows = rows.join(k.select(F.col("id").alias("leaf"), F.col("k").alias("_k")), "leaf", "left")
    rows = rows.join(k.select(F.col("id").alias("site_leaf"), F.col("k").alias("_s")), "site_leaf", "left").join(m, "host", "left")
    rows = rows.withColumn("_t", F.lit(total).cast("long")).withColumn("importance", F.least(_low("_k", "m"), _low("_s", "_t")))
    return rows.drop("_k", "_s", "_t", "m")


def style_tree(scored: DataFrame) -> DataFrame:
    """(page, branch, keep) from leaves with their importance: the merged trees of all hosts decide on the branches of every page."""
    from palmleaf.session import stage

    one = scored.groupBy("page", "host", "node", "branch").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("importance")).alias("w"), F.first("shape").alias("shape"), F.first("children").alias("children"))
    one = stage(one, "branches")
    shapes = one.groupBy("host", "node", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("w").alias("w"), F.sum("children").alias("children"))
    node = shapes.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("_e"), F.sum("size").alias("size"), F.sum("w").alias("w"), F.sum("children").alias("children"))
    presentation = F.when(F.col("n") > 1, (F.log("n") - F.col("_e") / F.col("n")) / F.log("n")).otherwise(F.lit(1.0))
    damp = F.pow(F.lit(GAMMA), F.col("children") / F.col("n"))
    node = node.withColumn("composite", (1 - damp) * presentation + damp * F.col("w") / F.col("size"))
    on_page = one.groupBy("page", "host", "node").agg(F.sum("size").alias("_size"), F.sum("w").alias("_w"))
    pages = on_page.groupBy("host", "node").agg(F.avg("_size").alias("carried"))
    node = stage(node.join(pages, ["host", "node"]).select("host", "node", "composite", (F.col("composite") * F.col("carried")).alias("weight")), "nodes")
    node = node.join(node.groupBy("host").agg(F.max("weight").alias("best")), "host")
    top = on_page.groupBy("page").agg(F.max_by("node", F.struct("_w", "node")).alias("_top"))
    heavy = (F.col("weight") >= BRANCH_SHARE * F.col("best")) | ((F.col("_w") >= BRANCH_SHARE * F.col("best")) & (F.col("node") == F.col("_top")))
    keep = on_page.join(node, ["host", "node"]).join(top, "page").select("page", "node", heavy.alias("keep"))
    return one.select("page", "node", "branch").join(keep, ["page", "node"]).select("page", "branch", "keep")


def decide(lines: list[tuple[int, bool | None, bool, bool, int]]) -> list[int]:
    """Numbers of the lines that are not the story's.

    Each line: (line_no, on a kept branch of its page or None if its page has no such leaf, its
    content is of low importance, it is known as furniture, bits).
    """
    out, open_ = [], []
    paged = any(keep is not None for _, keep, _, _, _ in lines)
    for k, (no, keep, low, known, bits) in enumerate(lines):
        if keep is False or low and bits & TELLING and not bits & _OWN or keep is None and known and not bits & (TITLE | BREAK | SPEECH):
            out.append(no)
        elif keep is None and not paged:
            open_.append(k)
    if open_:  # no page: the places of the lines around the story decide on the rest
        gone = set(out)
        title = next((k for k, x in enumerate(lines) if x[4] & TITLE and x[0] not in gone), None)
        body = [k for k, x in enumerate(lines) if x[4] & LONG_LINE and x[0] not in gone]
        after = body and next((k for k in range(body[-1] + 1, len(lines)) if lines[k][0] in gone), None)
        for k in open_:
            no, _, _, _, bits = lines[k]
            if bits & (TITLE | LONG_LINE | SPEECH | BREAK):
                continue
            if title is not None and k < title or after and k > after and not bits & ENDED:
                out.append(no)
    return sorted(out)


def boilerplate(stories: DataFrame, pages: DataFrame) -> DataFrame:
    """(story_id, line_no) of every line that is not part of the story itself."""
    found = matched(stories, pages)
    row = F.array_sort(F.collect_list(F.struct("line_no", "keep", "low", "known", "bits")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, ls in zip(b["story_id"], b["ls"]):
                rows += [(i, no) for no in decide([(x["line_no"], x["keep"], x["low"], x["known"], x["bits"]) for x in ls])]
            yield pd.DataFrame(rows, columns=["story_id", "line_no"])

    return found.groupBy("story_id").agg(row.alias("ls")).mapInPandas(judge, "story_id long, line_no long").distinct()


def matched(stories: DataFrame, pages: DataFrame) -> DataFrame:
    """(story_id, page, line_no, keep, low, known, bits) of every line; keep is NULL where its page has no such leaf."""
    from palmleaf.session import stage

    cut, lines = stage(parsed(pages), "page_leaves"), stage(story_lines(stories), "story_lines")
    k, m, total = content_counts(cut, lines)
    branches = stage(style_tree(_importance(cut.select("page", "host", "node", "shape", "children", "branch", "leaf", "site_leaf", "size"), k, m, total)), "kept_branches")
    kept = cut.select("page", "branch", "title", "line", "parts").join(branches, ["page", "branch"])
    by_line = kept.groupBy("page", "line").agg(F.max("keep").alias("keep"))
    lines = _importance(lines, k, m, total).withColumn("low", F.col("importance") < LEAF_IMPORTANCE)
    with_page = lines.where("page <> 0").join(by_line, ["page", "line"], "left")
    cols = ["story_id", "page", "title", "line_no", "keep", "low", "bits", "parts"]
    lines = stage(with_page.select(*cols).unionByName(lines.where("page = 0").withColumn("keep", F.lit(None).cast("boolean")).select(*cols)), "lines")
    # what the trees learned: parts of lines that recur, and stand off the kept branches more often than on them
    strange = lines.where("keep is null").select("story_id", "line_no", "title", F.explode("parts").alias("part"))
    stands = kept.select(F.explode("parts").alias("part"), "title", "keep").unionByName(strange.select("part", "title", F.lit(False).alias("keep"))).distinct()
    sums = stands.groupBy("part").agg(F.count_if(~F.col("keep")).alias("off"), F.count_if("keep").alias("on"))
    least = max(MIN_STORIES, total ** (1 - LEAF_IMPORTANCE))
    furniture = stage(sums.where((F.col("off") >= least) & (F.col("off") > F.col("on"))).select("part"), "furniture")
    known = strange.join(furniture, "part", "left_semi").select("story_id", "line_no").distinct().withColumn("known", F.lit(True))
    rest = lines.where("keep is null").join(known, ["story_id", "line_no"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    cols = ["story_id", "page", "line_no", "keep", "low", "known", "bits"]
    return lines.where("keep is not null").withColumn("known", F.lit(False)).select(*cols).unionByName(rest.select(*cols))
