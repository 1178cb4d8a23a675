"""Text statistics per document, fixed-threshold rules, and the kind of what isn't prose.

Method: vectorized statistics of length, symbols, end punctuation, bullets and common words, then published
fixed thresholds with a recorded reason for every failure. All of it is JVM-side expressions; no Python sees a text.

The same kinds of statistics are taken of every line (words, mean word length, symbols, end punctuation,
bullets, cells, repetition) and held against fixed thresholds; the characters of the lines that fail add up to three more
statistics of the document, the shares that are entries of a list, rows of a table and junk. Above
MAX_KIND_SHARE a share is a failure like any other, and the reason names the kind.

Scale: lines are exploded beside their neighbours where they are read and summed per document before the shuffle, which
carries one short row per document.

Nulls: a NULL text has NULL statistics, no failure and no kind; an empty text
has word count 0, shares of 0 and fails the length rule. Whole texts count,
however long; each document is independent, so there is no hot group. Rows of one id are judged one by one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.session import spread

#: The eight common English words and the bounds of the published rules for web text.
COMMON_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 3.0, 10.0
MAX_SYMBOL_RATIO, MAX_BULLET_SHARE, MAX_ELLIPSIS_SHARE = 0.1, 0.9, 0.3
MIN_END_PUNCTUATION, MIN_ALPHA_SHARE = 0.1, 0.8
#: More than this share of the characters makes a document a list, a table or junk; two kinds can't both exceed it.
MAX_KIND_SHARE = 0.5

END_MARKS = r"[.!?…।\"”’'\)]\s*$"
BULLET = r"^\s*[-*•‣·–]\s"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole, 6)).otherwise(F.lit(0.0))


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, end_punctuation_share, bullet_share,
    ellipsis_share, alpha_word_share, common_word_share)."""
    df = documents.select("doc_id", "text")
    df = df.withColumn("_w", F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\r]")))
    n, m = F.size("_w"), F.size("_l")
    count = lambda arr, pattern: F.size(F.filter(arr, lambda x: x.rlike(pattern)))
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#…{}<>|\\^~=+*_$%@&]", ""))
    common = F.size(F.filter("_w", lambda w: F.regexp_replace(w, r"[^a-z]", "").isin(*COMMON_WORDS)))
    there = F.col("text").isNotNull()
    guard = lambda c: F.when(there, c)
    return df.select(
        "doc_id",
        guard(n).cast("long").alias("n_words"),
        guard(_share(F.length(F.array_join("_w", "")), n)).alias("mean_word_length"),
        guard(_share(symbols, n)).alias("symbol_ratio"),
        guard(_share(count("_l", END_MARKS), m)).alias("end_punctuation_share"),
        guard(_share(count("_l", BULLET), m)).alias("bullet_share"),
        guard(_share(count("_l", r"(\.\.\.|…)\s*$"), m)).alias("ellipsis_share"),
        guard(_share(count("_w", r"\p{L}"), n)).alias("alpha_word_share"),
        guard(_share(common, n)).alias("common_word_share"),
    )


def failures(stats: DataFrame) -> DataFrame:
    """``stats`` with ``reasons``: the failed rules of the statistics it has, in order, separated by commas; '' if none failed."""
    c = F.col
    rules = [
        ("too_few_words", "n_words", lambda x: x < MIN_WORDS),
        ("too_many_words", "n_words", lambda x: x > MAX_WORDS),
        ("word_length", "mean_word_length", lambda x: (x < MIN_MEAN_LENGTH) | (x > MAX_MEAN_LENGTH)),
        ("symbols", "symbol_ratio", lambda x: x > MAX_SYMBOL_RATIO),
        ("bullets", "bullet_share", lambda x: x > MAX_BULLET_SHARE),
        ("ellipses", "ellipsis_share", lambda x: x > MAX_ELLIPSIS_SHARE),
        ("no_end_punctuation", "end_punctuation_share", lambda x: x < MIN_END_PUNCTUATION),
        ("few_letters", "alpha_word_share", lambda x: x < MIN_ALPHA_SHARE),
        ("list", "list_share", lambda x: x > MAX_KIND_SHARE),
        ("table", "table_share", lambda x: x > MAX_KIND_SHARE),
        ("junk", "junk_share", lambda x: x > MAX_KIND_SHARE),
    ]
    return stats.withColumn("reasons", F.concat_ws(",", *[F.when(rule(c(col)), F.lit(name)) for name, col, rule in rules if col in stats.columns]))


# What a line's characters say.
_CLEAN = r"(?<!\S)[\"'“‘(]?[A-Za-z\u0900-\u0dff\u200c\u200d]+(?:['’\-][A-Za-z]+)*[.,;:!?\"'”’)…।]*(?!\S)"
_SYMBOL = r"[\w\s.,;:!?'\"“”‘’()\-–—…।\p{L}\p{M}\u200c\u200d]"
_BROKEN = r"[^\u0080-\u00ffŒœŠšŸŽžƒˆ˜†‡•€™\ufffd]"
_ODD = r"[#-&*+/0-9;-@\[-`{-\u08ff\u0e00-\u200b\u200e-\u2012\u2015-\u2017\u201a\u201b\u201e-\u2025\u2027-\uffff]"
_CLUSTER = r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5}|\b[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{2,4}\b"
_CODE = r"function\s*\w*\s*\(|\bvar \w+\s*=|=>|\)\s*;|;\s*$|\{\s*$|^\s*\}|&&|\|\||\w\.\w+\("
_LATIN = r"[a-zA-Z]+"
_UNSAID = r"(?i)\b[a-z]*[bcdfghjklmnpqrstvwxz]{5}[a-z]*|\b[bcdfghjklmnpqrstvwxz]{2,}\b"
_INSIDE = r"[A-Za-z][,;][A-Za-z]|[A-Za-z];[,;]|\d[A-Za-z]+\d"
_END = r"[.!?…।]['\"”’)]*(?:\s|$)"
_MARK = r"^\s*(?:[-*•‣·–+]|\(?\d{1,5}[.):]|\[\d{1,5}\]|[a-zA-Z][.)])\s+(?=\S)"
_NUMBER = r"(?:\.{2,}|…|\s{2,}|\t)\s*\d+\s*$"
_RULE = r"^[\s|+:\-=─━]+$"
#: Wide gaps between cells; the other separators are bars, tabs, and semicolons and commas without a blank after them.
_GAP = r"\S\s{2,}(?=\S)"
#: Fixed thresholds of the lines.
_SHORT_WORDS, _LONG_WORDS, _SYMBOLS, _BROKEN_SHARE, _UNSAID_SHARE, _DISTINCT, _CLEAN_SHARE = 2.0, 24.0, 0.3, 0.2, 0.3, 0.2, 0.9
_CELL_LENGTH, _ROWS, _ENTRIES, _ENTRY_WORDS, _MEAN_ENTRY, _KEYWORD_WORDS, _ENDED = 32, 3, 4, 9, 4.6, 3.2, 0.25


def _lines(documents: DataFrame) -> DataFrame:
    """One row per line that is not blank, beside the two lines on either side: (_row, doc_id, x, p1, p2, n1, n2)."""
    rows = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_l", F.filter(F.split("text", "\n"), lambda y: y.rlike(r"\S")))
    m = F.size("_l")
    rows = rows.where(m > 0)
    none = F.array(F.lit(None).cast("string"))
    first, last = (lambda k: F.slice("_l", 1, F.greatest(m - k, F.lit(0)))), (lambda k: F.slice("_l", k + 1, F.greatest(m - k, F.lit(0))))
    shifted = {"x": F.col("_l"), "p1": F.concat(none, first(1)), "p2": F.concat(none, none, first(2)), "n1": last(1), "n2": last(2)}
    return rows.select("_row", "doc_id", F.inline(F.arrays_zip(*[c.alias(k) for k, c in shifted.items()]))).where("x is not null")


def line_statistics(lines: DataFrame) -> DataFrame:
    """``lines`` with n, the length of the line, and kind: list, table, junk, bare (a list if there are enough of them), ended (a short line that ends a sentence) or NULL."""
    x, n, nw = F.col("x"), F.col("n"), F.col("nw")
    count = lambda p: F.regexp_count(x, F.lit(p))
    times = lambda y, c: F.length(y) - F.length(F.replace(y, F.lit(c), F.lit("")))
    without = lambda p: F.length(F.regexp_replace(x, p, ""))
    # cheap tests stand first in every condition: what follows them runs on few lines only
    df = lines.withColumn("n", F.length(x)).withColumn("w", F.split(F.btrim(x, F.lit(" \t\r\f\x0b")), r"\s+")).withColumn("nw", F.size("w"))
    df = df.withColumn("odd", x.rlike(_ODD) | (x.contains(",") & x.rlike("[A-Za-z],[A-Za-z]")) | x.rlike(_CLUSTER))
    df = df.withColumn("clean", (nw >= 5) & (n > 3 * nw) & (~F.col("odd") | (count(_CLEAN) >= _CLEAN_SHARE * nw)))
    # junk: the same words or lines again and again, words too short or too long, symbols, broken encoding, code, unsayable words
    same = ((x == F.col("p1")) & ((x == F.col("p2")) | (x == F.col("n1")))) | ((x == F.col("n1")) & (x == F.col("n2")))
    again = (nw >= 6) & (F.size(F.array_distinct("w")) <= F.greatest(F.lit(1), F.floor(_DISTINCT * nw)))
    letters = count(_LATIN)
    said = [
        (nw >= 8) & (n + 1 - nw < _SHORT_WORDS * nw),
        (n > _LONG_WORDS * nw) & x.rlike(r"[A-Za-z0-9+/=_\-]{32}"),
        without(_SYMBOL) > _SYMBOLS * n,
        without(_BROKEN) > _BROKEN_SHARE * n,
        (x.contains("(") | x.contains("{")) & (without(r"[^(){};=\[\]]") > 0.08 * n) & (count(_CODE) >= 2),
        x.rlike(_CLUSTER) & (letters >= 4) & (count(_UNSAID) > _UNSAID_SHARE * letters),
    ]
    ruled = x.contains("-") & ~x.rlike(r"[\p{L}\p{N}]") & x.rlike(_RULE)
    df = df.withColumn("ruled", ruled).withColumn("junk", F.coalesce(same, F.lit(False)) | again | (F.col("odd") & ~F.col("clean") & ~F.col("ruled") & reduce(or_, said)))
    # a row of a table: as many cells as a line nearby has, all of them short on average
    signs = [("|", None), ("\t", None), (";", "; "), (",", ", ")]
    cells = lambda y, c, off: times(y, c) - (F.floor(times(y, off) / 2) if off else 0)
    around = [F.col(c) for c in ("p1", "n1", "p2", "n2")]
    rows = [x.contains(c) & (cells(x, c, off) > 0) & (n <= _CELL_LENGTH * (cells(x, c, off) + 1)) & reduce(or_, [F.coalesce(y.contains(c) & (cells(y, c, off) == cells(x, c, off)), F.lit(False)) for y in around]) for c, off in signs]
    wide = lambda y: F.coalesce(F.trim(y).contains("  ") & y.rlike(_GAP), F.lit(False))
    rows.append(wide(x) & reduce(or_, [wide(y) for y in around]))
    df = df.withColumn("table", ~F.col("junk") & (reduce(or_, rows) | F.col("ruled")))
    mashed = (letters >= 4) & (count(_UNSAID) + count(_INSIDE) > _UNSAID_SHARE * letters)
    df = df.withColumn("junk", F.col("junk") | (F.col("odd") & ~F.col("clean") & ~F.col("table") & mashed))
    # an entry of a list: marked or numbered and no sentence, a line of keywords, or bare, short and no sentence
    few = nw <= _ENTRY_WORDS + 4
    bare = F.when(few, F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), _MARK, ""), r"\s*\([^()]{1,24}\)\s*$", ""), _NUMBER, ""))
    df = df.withColumn("short", few & ~bare.rlike(_END))
    commas = F.floor(times(x, ", ") / 2)
    keywords = (commas >= 2) & (nw <= _KEYWORD_WORDS * (commas + 1)) & ~F.regexp_replace(x, r"[.,;\s]+$", "").rlike(_END) & ~x.rlike(r"(?:[^\s,]++\s++){8}[^\s,]")
    numbered = few & (nw > 1) & x.rlike(_NUMBER)
    entry = (nw <= _ENTRY_WORDS) & F.col("short") & ~x.rlike("^\\s*[\"“‘']") & ~x.rlike(r"[,:;–—\-]\s*$")
    kind = F.when(F.col("junk"), "junk").when(F.col("table"), "table").when((F.col("short") & x.rlike(_MARK)) | keywords | numbered, "list").when(entry, "bare").when(few & ~F.col("short"), "ended")
    return df.select("_row", "doc_id", "n", "nw", kind.alias("kind"))


def shares(documents: DataFrame) -> DataFrame:
    """(doc_id, list_share, table_share, junk_share) of every document with a line: shares of the characters of its lines."""
    lines = line_statistics(_lines(documents))
    is_ = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    total = lambda k, c: F.sum(F.when(is_(k), F.col(c)).otherwise(0))
    sums = lines.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n"), *[total(k, "n").alias(k) for k in ("list", "table", "junk", "bare")],
        total("bare", "nw").alias("w"), F.count_if(is_("bare")).alias("b"), F.count_if(is_("ended")).alias("e"), F.count_if(is_("table")).alias("r"),
    )
    # bare entries and rows count only where there are enough of them, entries only if they are short on average and few lines among them end sentences, as those of verse do
    entries = F.when((F.col("b") >= _ENTRIES) & (F.col("w") <= _MEAN_ENTRY * F.col("b")) & (F.col("e") <= _ENDED * F.col("b")), F.col("bare")).otherwise(0)
    rows = F.when(F.col("r") >= _ROWS, F.col("table")).otherwise(0)
    return sums.select("doc_id", _share(F.col("list") + entries, F.col("n")).alias("list_share"), _share(rows, F.col("n")).alias("table_share"), _share(F.col("junk"), F.col("n")).alias("junk_share"))


def kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are a list, a table or junk; the kind is the recorded reason."""
    return failures(shares(documents)).where("reasons <> ''").select("doc_id", F.col("reasons").alias("kind")).distinct()
