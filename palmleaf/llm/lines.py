"""Lines repeated across the documents of one site.

Method: PrefixSpan, level by level and distributed, over the sequences of line
identifiers of each source. A pattern is frequent if it occurs in documents of
at least ``min_support`` different urls of its source; a document counts once.
Level one holds the single lines. A longer pattern extends a frequent prefix by
a frequent line that follows its last line within ``max_gap`` kept lines. Growth
ends when no pattern of a level is frequent. What is deleted are the occurrences
of the patterns of all levels: each level gives the line that it adds to the
occurrences of its prefixes, whose other lines the levels before have given.
Every line of a frequent sequence is frequent by itself (support can only fall
when a pattern grows), so the lines of all levels are those of level one; a test
compares the two.

Nulls: rows without text, source or url neither count nor are listed. Empty
texts have no lines. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table of frequent lines is broadcast only up to this many rows (about 40 bytes each).
BROADCAST_ROWS = 200_000
#: A line with any other character than white space.
NOT_BLANK = r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Beyond that, both sides are spread over so many parts of each key, so a line that a third of all rows hold is many tasks.
SALTS = 16


def line_key(line: Column) -> Column:
    """Lower-cased line in which every run of other characters than letters is one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", " "))


def numbered_lines(df: DataFrame, text_col: str, *cols: str) -> DataFrame:
    """(cols, line_no, line): the lines that are not blank, numbered from 1."""
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(NOT_BLANK))
    return df.where(F.col(text_col).isNotNull()).select(*cols, F.posexplode(kept).alias("_p", "line")).select(*cols, (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def keyed_lines(stories: DataFrame, min_letters: int) -> DataFrame:
    """(story_id, src, url, line_no, k): k is the 64-bit identifier of a line within its source."""
    rows = stories.where("source_host is not null and source_host <> '' and url is not null and original_text is not null")
    rows = rows.select("story_id", F.xxhash64("source_host").alias("src"), F.xxhash64("url").alias("url"), "original_text")
    keyed = numbered_lines(rows, "original_text", "story_id", "src", "url").withColumn("key", line_key(F.col("line")))
    keyed = keyed.where(F.length(F.replace(F.col("key"), F.lit(" "), F.lit(""))) >= min_letters)
    return keyed.select("story_id", "src", "url", "line_no", F.xxhash64("src", "key").alias("k"))


def frequent_items(items: DataFrame, min_support: int) -> DataFrame:
    """(src, k, support): level one. Distinct (line, url) pairs combine before the shuffle,
    so a hot line of a hot source arrives as at most one row per task and url."""
    return items.select("src", "k", "url").distinct().groupBy("src", "k").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)


def _against(items: DataFrame, frequent: DataFrame, on: list[str], how: str) -> DataFrame:
    if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return items.join(F.broadcast(frequent), on, how)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("story_id"), F.lit(SALTS)).cast("int"))
    return salted.join(frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how).drop("_salt")


def prefixspan(stories: DataFrame, min_support: int = 5, max_len: int | None = None, max_gap: int = 1, min_letters: int = 12) -> tuple[DataFrame, DataFrame]:
    """(patterns, occurrences).

    patterns: (src, pattern array<long>, support), of every length, or of 1 to ``max_len``. The levels end by
    themselves: each needs a frequent prefix, and a text has finitely many lines.
    occurrences: (story_id, line_no, n_lines), a row for each frequent pattern of n_lines lines that ends in that line.
    """
    from palmleaf.session import stage

    items = keyed_lines(stories, min_letters)
    single = stage(frequent_items(items, min_support), "frequent_lines")
    found = _against(items, single.select("src", "k"), ["src", "k"], "left_semi")
    patterns = single.select("src", F.array("k").alias("pattern"), "support")
    ends = ["story_id", "line_no"]
    if max_len == 1:
        return patterns, found.select(*ends, F.lit(1).alias("n_lines"))
    found = stage(found, "frequent_occurrences")
    occurrences = found.select(*ends, F.lit(1).alias("n_lines"))
    # the projected database of a prefix: where its last line stands in each document
    db = stage(found.withColumn("pos", F.expr("row_number() over (partition by story_id order by line_no)")), "positions")
    nxt = db.select("story_id", F.col("pos").alias("_next"), "line_no", "k")
    projected = db.select("src", "story_id", "url", "pos", F.array("k").alias("pattern"))
    length = 1
    while max_len is None or length < max_len:
        length += 1
        after = projected.withColumn("_next", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + max_gap)))
        grown = after.join(nxt, ["story_id", "_next"])
        grown = grown.select("src", "story_id", "url", F.col("_next").alias("pos"), "line_no", F.concat("pattern", F.array("k")).alias("pattern"))
        longer = grown.select("src", "pattern", "url").distinct().groupBy("src", "pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
        longer = stage(longer, "patterns")
        if not longer.take(1):
            break
        patterns = patterns.unionByName(longer)
        projected = stage(_against(grown, longer.select("src", "pattern"), ["src", "pattern"], "left_semi"), "projected")
        occurrences = occurrences.unionByName(projected.select(*ends, F.lit(length).alias("n_lines")))
        projected = projected.drop("line_no")
    return patterns, occurrences


def repeated_lines(stories: DataFrame, min_support: int = 5, min_letters: int = 12) -> DataFrame:
    """(story_id, line_no) of every line in an occurrence of a frequent sequence of any length."""
    _, found = prefixspan(stories, min_support, min_letters=min_letters)
    return found.select("story_id", "line_no").distinct()


def without_repeated(stories: DataFrame, min_support: int = 5, min_letters: int = 12) -> DataFrame:
    """(story_id, clean_text, n_removed): every text without its repeated lines.

    A text without repeated lines comes back as it is, a NULL text as NULL.
    """
    found = repeated_lines(stories, min_support, min_letters).groupBy("story_id").agg(F.collect_set("line_no").alias("_drop"))
    rows = stories.select("story_id", F.split("original_text", "\n").alias("_l"), "original_text").join(found, "story_id", "left")
    # the places of the lines that are not blank, of those to drop, and of those that stay; all sets of numbers
    every = F.sequence(F.lit(1), F.size("_l"))
    told = F.filter(every, lambda i: F.element_at("_l", i).rlike(NOT_BLANK))
    rows = rows.withColumn("_told", told).withColumn("_gone", F.transform("_drop", lambda k: F.element_at("_told", k.cast("int"))))
    clean = F.array_join(F.transform(F.array_except(every, "_gone"), lambda i: F.element_at("_l", i)), "\n")
    n = F.greatest(F.coalesce(F.size("_drop"), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("story_id", F.when(F.col("_drop").isNull(), F.col("original_text")).otherwise(clean).alias("clean_text"), n.alias("n_removed"))
