"""Records that hold template residue, filler or a notice instead of a story.

Method: near-duplicates from partitioned SimHash tables, verified by Hamming distance and text similarity;
trusted labels then spread through the connected components.

What is compared is a *message*: a row's text, of any length, without site furniture. Furniture is counted, not
listed: lines whose content (letters, the site's name masked) recurs under MIN_TITLES titles or more, mostly in rows that
have a story besides. Messages are normalised (case, numbers, hex identifiers), and equal ones
are one node, so a notice that a third of all rows hold is one node with one count.

Fingerprint: a SimHash of BITS bits over a message's words, cut into TABLES blocks of BLOCK bits. Two messages
meet in a table if they agree on its block. A bit differs with probability acos(c) / pi at cosine
c, so a pair at MIN_SIMILARITY (Jaccard 0.6, cosine 0.75) shares no block with probability
0.023, one at 0.8 with 3e-6. Candidates within RADIUS bits are verified on their words.

Trusted labels: messages of the same words under MIN_TITLES different titles or more (a story is reprinted
under its own title, a notice under any), and those of which a share is made up by a few
standard phrases of servers and browsers (SEEDS), lines of error dumps or words drawn again and again from a small
stock, or by lines that recur like furniture, but mostly in rows without a story. A component is residue if its trusted
rows outnumber its stories, if its rows stand under MIN_TITLES titles or more and none of them is a story, or if none
of them reaches STUB_WORDS words. A story has at least STORY_WORDS words of its own.

A slot that was never filled makes its row a case whatever stands around it, so slots are told by their shape in the
row itself and their label does not spread: it would mark the filled copies of the story.

Nulls: a NULL or blank text is no case; a missing title is replaced by the url. status and error are not looked at:
they may say anything. Extra columns are ignored. Copies of a row's id are one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.lines import line_key, numbered_lines
from palmleaf.llm.words import WordHasher, mix, odd_multipliers, words
from palmleaf.session import spread

#: A story has at least so many words on lines that don't recur; it speaks against the label of its component.
STORY_WORDS = 60
#: No story is shorter than this; a component of nothing but shorter messages holds none.
STUB_WORDS = 20
#: Contents and messages under so many titles belong to no single story.
MIN_TITLES = 4
#: A line under more titles than this power of their number is no story's own.
OFTEN = 0.3
#: Share of a message that must be notice, if it is shorter than a story and if it is not, and that must be filler.
NOTICE_SHORT, NOTICE_LONG, FILLER = 1 / 3, 0.5, 0.9
#: Filler draws on so few different words; romanised stories without short words have more.
FILLER_STOCK = 0.5
#: SimHash: TABLES blocks of BLOCK bits; largest Hamming distance, 3.5 deviations above the mean at MIN_SIMILARITY.
TABLES, BLOCK = 85, 12
BITS, RADIUS = 1024, 283
#: Verified similarity: words that both messages have over words that one has.
MIN_SIMILARITY = 0.6
#: A bucket above this size is cut into blocks, and every two blocks are compared by a task of their own.
MAX_BUCKET = 400

# Shapes of template slots.
SLOT = (
    r"\{\{[^{}\n]+\}\}|<%[^%\n]+%>|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|\[\[[A-Za-z_][\w ]*\]\]|\[%[^%\n]+%\]|\{%[^%\n]+%\}"
    r"|__[A-Z][A-Z0-9_]{2,}__|%%[A-Za-z_]{2,}%%|%[A-Z][A-Z_]{3,}%|@@[A-Za-z_]{2,}@@|<<[A-Za-z_]{2,}>>|\{[A-Z]+_[A-Z_]+\}|\{[a-z]+_[a-z_]+\}|\{\d{1,3}\}"
    r"|\bX{2,}[A-Z_]{2,}X{2,}\b|\[object \w+\]|\[(?:insert|your|enter|add) [^\]\n]+\]|\[(?:TITLE|AUTHOR|BODY|NAME|TEXT|DATE|CONTENT)\]"
)
# A few standard phrases of servers, browsers and templates, lower case.
SEEDS = (
    "not found", "could not be found", "access denied", "forbidden", "bad gateway", "gateway timeout", "internal server error", "service unavailable", "temporarily unavailable",
    "too many requests", "went wrong", "error code", "database error", "maintenance", "has expired", "no longer available", "not available in your", "enable javascript", "scripts", "javascript",
    "not a robot", "could not be loaded", "was removed", "was deleted", "lorem ipsum", "placeholder", "goes here", "do not publish", "to be filled in", "to be replaced", "draft only",
)
# Lines of stack traces and logs.
_DUMP = re.compile(
    r"^\s*at [\w.$<>/]+ ?\(|^\s*File \"[^\"]+\", line \d+|^\s*Caused by:|^\s*\.\.\. \d+ more$|^\s*#\d+ +\S+[/(:]|^\s*[\w.]+(?:Error|Exception)\b|\bin \S+ on line \d+"
    r"|^\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S*.*\b(?:ERROR|WARN(?:ING)?|FATAL|INFO|DEBUG|CRITICAL)\b|^\s*\[(?:error|warn|crit)[\]:]|^Traceback "
)
# The stock of the printers' filler.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi"
    " aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# What a text with such a line, or with a slot, holds as it stands: all of one of the groups, and one of the pieces (or xx in any case).
_DUMP_SIGNS = (("(", "at "), ('File "', ", line "), ("Caused by:",), ("... ", " more"), ("#",), ("Error",), ("Exception",), (" on line ",), ("[",), ("Traceback ",), *((x,) for x in ("ERROR", "WARN", "FATAL", "INFO", "DEBUG", "CRITICAL")))
_SLOT_SIGNS = ("{", "[", "<%", "<<", "%", "@@", "__")
# Pieces of seeds, shared by several or with a rarer first letter: what is searched first. A text without a seed's piece doesn't hold the seed.
_PIECES = ("found", "denied", "gateway", "rror", "vailable", "quests", "xpired", "cript", "robot", "publish", "filled in", "be replaced", "ft only")
#: Most bits that tell which rows are wanted before their texts are moved, and bits for each row.
MOST_BITS, BITS_A_ROW = 1 << 26, 16
_SENTENCE = re.compile(r"(?<=[.!?…।])\s+")
_HEX = re.compile(r"\b(?=[0-9a-f-]*\d)[0-9a-f]{2,}(?:-[0-9a-f]+)*\b")


def normal(text: str, site: str = "") -> list[str]:
    """Words of a message without numbers, hex identifiers and the site's name."""
    low = text.lower()
    return words(_HEX.sub(" ", low.replace(site, " ") if site else low))


_PLANES = odd_multipliers(BITS // 64, 53)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """BITS bits: the signs of the sums over all words, each word a random point on the cube."""
    if not len(hashes):
        return np.zeros(BITS // 64, np.uint64)
    points = mix(hashes[:, None] * _PLANES)
    bits = np.unpackbits(points.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)


def table_keys(fp: np.ndarray) -> np.ndarray:
    """One key for each table: its number and its block of the fingerprint."""
    bits = np.unpackbits(fp.view(np.uint8), bitorder="little")[: TABLES * BLOCK].reshape(TABLES, BLOCK).astype(np.int64)
    return (np.arange(TABLES, dtype=np.int64) << BLOCK) + bits @ (1 << np.arange(BLOCK, dtype=np.int64))


def miss_probability(similarity: float) -> float:
    """Probability that two messages of this Jaccard similarity share no block."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return (1 - (1 - differ) ** BLOCK) ** TABLES


def _repeats(ws: list[str]) -> bool:
    """Words drawn again and again from a small stock without any grammar: many repeat, none is short."""
    return len(ws) >= 12 and len(set(ws)) <= 0.72 * len(ws) and all(len(w) > 3 and w.isascii() for w in ws)


def judged(lines: list[tuple[str, bool]], seeds: tuple[str, ...] = SEEDS) -> bool:
    """Whether so much of a message, (line, counted as notice), is notice, dump or filler that it is trusted to be no story."""
    n = notice = filler = 0
    inside, stock = False, set()
    for line, noted in lines:
        ws = words(line)
        if not ws:
            continue
        inside = bool(_DUMP.search(line) or inside and line[0].isspace())
        low = line.lower()
        if inside or noted:
            notice += len(ws)
        elif any(x in low for x in seeds):
            notice += sum(len(words(x)) for x in _SENTENCE.split(low) if any(y in x for y in seeds))
        if _repeats(ws) or sum(w in _LOREM for w in ws) > 0.6 * len(ws):
            filler += len(ws)
        n += len(ws)
        stock.update(ws)
    if len(stock) > FILLER_STOCK * n and n >= STORY_WORDS:  # prose that repeats itself
        filler = 0
    return n > 0 and (notice >= (NOTICE_SHORT if n < STORY_WORDS else NOTICE_LONG) * n or filler >= FILLER * n)


def _site() -> Column:
    """The site's name, from source_host or the url: the words of the first label that hold no digit."""
    host = F.coalesce(F.when(F.col("source_host") != "", F.col("source_host")), F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]+)", 1))
    label = F.split(F.regexp_extract(F.lower(host), r"^(?:www\.)?([^.]*)", 1), "-")
    return F.array_join(F.filter(label, lambda w: (w != "") & ~w.rlike("[0-9]")), " ")


def _says(low: Column, phrases: set[str]) -> Column:
    """Whether a text holds one of the phrases, piece by piece; a phrase around another adds nothing."""
    by: dict[str, list[str]] = {}
    for x in sorted(phrases):
        if not any(y != x and y in x for y in phrases):
            by.setdefault(next((p for p in _PIECES if p in x), x), []).append(x)
    return reduce(or_, [low.contains(p) & reduce(or_, map(low.contains, xs)) if xs != [p] else low.contains(p) for p, xs in by.items()])


def rows_with_lines(stories: DataFrame, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(rows, marked lines): (story_id, title, slot, signs, own) of every row with a text: whether it holds a
    slot, or signs of a notice, dump or filler, and its words on lines that don't recur often; and (story_id, gone, noted), the numbers of the lines that are furniture and notice."""
    from palmleaf.session import stage

    text = F.col("original_text")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"), F.lit(""))
    there = stories.where(F.col("story_id").isNotNull() & text.isNotNull() & text.rlike(r"\S"))
    there = there.select("story_id", F.xxhash64(F.lower(F.trim(title))).alias("title"), _site().alias("_site"), text)
    low = F.lower(text)
    there = spread(there).withColumn("slot", (reduce(or_, [text.contains(x) for x in _SLOT_SIGNS]) | low.contains("xx")) & text.rlike("(?i)" + SLOT))
    ws = F.split(low, r"\s+")
    said = _says(low, {*seeds, "lorem", "dolor"})
    traces = reduce(or_, [reduce(and_, map(text.contains, xs)) for xs in _DUMP_SIGNS]) & text.rlike("(?m)" + _DUMP.pattern)
    there = there.withColumn("signs", said | traces | (F.size(F.array_distinct(ws)) <= FILLER_STOCK * F.size(ws)))
    key = line_key(F.col("line"))
    masked = F.when(F.col("_site") != "", F.replace(key, F.col("_site"), F.lit("§"))).otherwise(key)
    n = F.size(F.filter(F.split("line", r"[\s\x{a0}]+"), lambda w: w != "")).alias("n")
    lines = numbered_lines(there, "original_text", "story_id", "title", "_site", "slot", "signs")
    lines = stage(lines.select("story_id", "title", "slot", "signs", "line_no", F.xxhash64(masked).alias("id"), n), "message_lines")
    recurring = stage(lines.select("id", "title").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k")).where(f"k >= {MIN_TITLES}"), "recurring_lines")
    often = max(MIN_TITLES, lines.select("title").distinct().count() ** OFTEN)
    flagged = lines.join(recurring, "id", "left")
    own = stage(flagged.groupBy("story_id").agg(F.first("title").alias("title"), F.max("slot").alias("slot"), F.max("signs").alias("signs"), F.sum(F.when(F.col("k") >= often, 0).otherwise(F.col("n"))).alias("own")), "own_words")
    # a recurring line is furniture if most rows around it have a story, and notice if not
    stands = flagged.where("k is not null").select("story_id", "line_no", "id").join(own.select("story_id", (F.col("own") >= STORY_WORDS).alias("story")), "story_id")
    side = stands.groupBy("id").agg((F.avg(F.col("story").cast("double")) > 0.5).alias("site"))
    marked = stands.join(side, "id").groupBy("story_id").agg(F.collect_set(F.when(F.col("site"), F.col("line_no"))).alias("gone"), F.collect_set(F.when(~F.col("site"), F.col("line_no"))).alias("noted"))
    return own, marked


def _wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose story_id is not in ``ids``: one hash of the id into a broadcast set of bits.

    The set has BITS_A_ROW bits an id, MOST_BITS (8 MB) at most. It never drops a wanted row; a join decides on the rest.
    """
    bits = min(MOST_BITS, 1 << max(16, (BITS_A_ROW * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("story_id"), F.lit(bits))
    word, bit = F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    told = ids.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    array = np.zeros(bits // 64, np.int64)
    array[told["w"].to_numpy()] = told["b"].to_numpy()
    one = rows.sparkSession.createDataFrame(pa.table({"_bits": pa.array([array], pa.list_(pa.int64()))}))
    return rows.join(F.broadcast(one), F.get("_bits", word).bitwiseAND(bit) != 0, "left_semi")


def _messages(stories: DataFrame, ids: DataFrame, gone: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(story_id, m, n, trusted, fp, set) of the rows in ``ids``."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            rows = []
            for i, text, site, out, noted in zip(b["story_id"], b["original_text"], b["site"], b["gone"], b["noted"]):
                ls = [x for x in text.split("\n") if x.strip()]
                drop, noted = (set() if x is None else {int(y) for y in x} for x in (out, noted))
                kept = [(x, no in noted) for no, x in enumerate(ls, 1) if no not in drop]
                ws = normal("\n".join(x for x, _ in kept), site)
                h = np.unique(hasher(ws)) if ws else np.empty(0, np.uint64)
                m = int(mix(hasher(ws) * odd_multipliers(len(ws), 3)).sum(dtype=np.uint64)) if ws else 0
                rows.append((i, m - (1 << 64) if m >> 63 else m, len(h), judged(kept, seeds), simhash(mix(h)).tobytes(), h.tobytes()))
            yield pd.DataFrame(rows, columns=["story_id", "m", "n", "trusted", "fp", "set"])

    rows = _wanted(stories.where("original_text is not null"), ids).select("story_id", "original_text", _site().alias("site")).join(ids, "story_id").join(gone, "story_id", "left")
    rows = rows.select("story_id", "original_text", "site", "gone", "noted").repartition(stories.sparkSession.sparkContext.defaultParallelism, "story_id")
    return rows.mapInPandas(make, "story_id long, m long, n int, trusted boolean, fp binary, set binary")


def links(nodes: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """(a, b): near-duplicates among the distinct messages (m, n, fp, set, story), without a cap on buckets.

    Two stories need no link here: a pair holds at least one message that is no story by itself.
    """
    from palmleaf.session import stage

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(keys=[table_keys(np.frombuffer(x, np.uint64)) for x in b["fp"]])[["m", "n", "story", "keys"]]

    rows = nodes.where("n > 0").select("m", "n", "story", "fp").mapInPandas(cut, "m long, n int, story boolean, keys array<long>").select("m", "n", "story", F.explode("keys").alias("key"))
    rows = stage(rows, "tables")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("story").alias("_all")).where("_n > 1 and not _all").drop("_all")
    split = rows.join(sizes, "key").withColumn("_s", F.ceil(F.col("_n") / MAX_BUCKET).cast("int"))
    one = split.where("not story").select("key", F.col("m").alias("a"), F.col("n").alias("na"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_p"))
    two = split.select("key", F.col("m").alias("b"), F.col("n").alias("nb"), "story", F.pmod(F.xxhash64("m"), F.col("_s")).cast("int").alias("_p"))
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    pairs = one.join(two, ["key", "_p"]).where("a < b or story").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x, y: nodes.select(F.col("m").alias(x), F.col("fp").alias("fp" + y), F.col("set").alias("set" + y))
    pairs = pairs.join(side("a", "_a"), "a").join(side("b", "_b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint64).reshape(len(f), -1) for c in ("fp_a", "fp_b"))
                f = f[np.bitwise_count(x ^ y).sum(1) <= RADIUS]
            keep = []
            for x, y in zip(f["set_a"], f["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield f.loc[keep, ["a", "b"]]

    return stage(pairs.mapInPandas(verify, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(m, c): the smallest node of the component of each node that has a link.

    Each round every node takes the smallest label among its neighbours and their
    labels' labels (pointer jumping), so the rounds grow with the logarithm of a chain. They end at the fixed point.
    """
    from palmleaf.session import stage

    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("m")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    moved = True
    while moved:
        seen = edges.join(labels.select(F.col("m").alias("b"), "c"), "b").groupBy(F.col("a").alias("m")).agg(F.min("c").alias("_n"))
        step = labels.join(seen, "m", "left").select("m", "c", F.least("c", "_n").alias("_n"))
        jump = labels.select(F.col("m").alias("_n"), F.col("c").alias("_j"))
        step = stage(step.join(jump, "_n", "left").select("m", "c", F.least("_n", "_j").alias("_new")), "labels")
        moved = not step.where("_new < c").isEmpty()
        labels = step.select("m", F.col("_new").alias("c"))
    return labels


def residue(stories: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(story_id) of every row that holds residue instead of a story, or a story with an unfilled slot."""
    from palmleaf.session import stage

    own, gone = rows_with_lines(stories, seeds)
    gone = stage(gone, "furniture_lines")
    first = own.where(f"own < {STORY_WORDS} or signs").select("story_id")
    some = stage(_messages(stories, first, gone, seeds), "messages")
    # a longer row can only be like a message of at least MIN_SIMILARITY of its words
    most = some.where("trusted").agg(F.max("n")).first()[0] or 0
    more = own.where(f"own >= {STORY_WORDS} and not signs").where(F.col("own") * MIN_SIMILARITY <= 2 * most).select("story_id")
    found = some.unionByName(stage(_messages(stories, more, gone, seeds).where(F.col("n") * MIN_SIMILARITY <= most), "more_messages"))
    keyed = found.join(own, "story_id").withColumn("story", F.col("own") >= STORY_WORDS)
    titles = keyed.groupBy("m").agg(F.count_distinct("title").alias("titles"))
    nodes = keyed.groupBy("m").agg(F.first("n").alias("n"), F.max("trusted").alias("trusted"), F.min("story").alias("story"), F.first("fp").alias("fp"), F.first("set").alias("set"), F.count(F.lit(1)).alias("rows"), F.max("own").alias("long"))
    nodes = nodes.join(titles, "m").withColumn("trusted", F.col("trusted") | ((F.col("titles") >= MIN_TITLES) & ~F.col("story")))
    nodes = stage(nodes, "nodes")
    comp = components(links(nodes.select("m", "n", "fp", "set", (F.col("story") & ~F.col("trusted")).alias("story"))))
    member = nodes.select("m", "trusted", "story", "rows", "long").join(comp, "m", "left").withColumn("c", F.coalesce("c", "m"))
    under = keyed.select("m", "title").join(comp, "m").select("c", "title").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("titles"))
    sums = member.groupBy("c").agg(F.sum(F.when(F.col("trusted"), F.col("rows")).otherwise(0)).alias("sure"), F.sum(F.when(F.col("story") & ~F.col("trusted"), F.col("rows")).otherwise(0)).alias("stories"), F.max("long").alias("long"))
    good = sums.join(under, "c", "left").where(f"sure > stories or stories = 0 and titles >= {MIN_TITLES} or long < {STUB_WORDS}").select("c")
    labelled = member.join(good, "c", "left_semi").select("m")
    return keyed.join(labelled, "m", "left_semi").select("story_id").unionByName(own.where("slot").select("story_id")).distinct()
