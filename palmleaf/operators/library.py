"""The story table: counts, search, acceptance, upserts, full text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions.text import contains_fold, epoch

SORTS = ("newest", "oldest", "title", "longest")


def counts(stories: DataFrame) -> DataFrame:
    """One row: all stories, those of each status, and those with a transliteration."""
    part = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "verified", "review", "failed")]
    return stories.agg(F.count(F.lit(1)).alias("total"), *part, F.count_if(F.col("romanized") == 1).alias("romanized"))


def filtered(stories: DataFrame, status: str = "", language: str = "", category: str = "all", wanted: str = "") -> DataFrame:
    """Status (verified, review or failed), language (telugu, romanized or english), category and
    a literal text without case in title, url or either text. Anything else filters nothing."""
    df = stories
    if status in ("verified", "review", "failed"):
        df = df.where(F.col("status") == status)
    flag = {"telugu": F.col("telugu") == 1, "romanized": F.col("romanized") == 1, "english": F.col("telugu") == 0}.get(language)
    if flag is not None:
        df = df.where(flag)
    if category and category != "all":
        df = df.where(F.col("category") == category)
    for word in wanted.split():
        df = df.where(contains_fold(F.col("title"), word) | contains_fold(F.col("url"), word) | contains_fold(F.col("original_text"), word) | contains_fold(F.col("romanized_text"), word))
    return df


def ordered(df: DataFrame, sort: str = "newest") -> DataFrame:
    """Newest first unless told otherwise; ties by id, so pages are stable."""
    key = {"oldest": epoch(F.col("updated_at")).asc(), "title": F.lower("title").asc_nulls_first(), "longest": F.col("words").desc_nulls_last()}
    return df.orderBy(key.get(sort, epoch(F.col("updated_at")).desc()), "story_id")


def page(stories: DataFrame, sort: str = "newest", number: int = 1, per_page: int = 50, **filters) -> DataFrame:
    per_page = min(100, max(10, per_page))
    return ordered(filtered(stories, **filters), sort).offset((max(1, number) - 1) * per_page).limit(per_page)


def tokens(text: Column) -> Column:
    """Full-text tokens: lower-case runs of letters and numbers; marks separate."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(stories: DataFrame, columns: tuple[str, ...] = ("title", "url", "original_text", "romanized_text")) -> DataFrame:
    """The inverted index: (story_id, col, pos, token)."""
    parts = [stories.where(F.col(c).isNotNull()).select("story_id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "token")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matches(index: DataFrame, query: str) -> DataFrame:
    """(story_id) of the rows that hold every phrase of the query in some column.

    Each piece between blanks is a phrase of its tokens; the last piece matches as a prefix. A piece
    without letters or numbers matches nothing. One grouped pass over the
    postings serves a query of single tokens, longer phrases join by position.
    """
    import re

    pieces = [[t for t in re.split(r"[\W_]+", p.lower()) if t] for p in query.split()]
    if not pieces or not all(pieces):
        return index.select("story_id").limit(0)
    found = None
    for k, phrase in enumerate(pieces):
        last = k == len(pieces) - 1
        hit = None
        for i, tok in enumerate(phrase):
            prefix = last and i == len(phrase) - 1
            cond = F.col("token").startswith(tok) if prefix else F.col("token") == tok
            here = index.where(cond).select("story_id", "col", (F.col("pos") - i).alias("pos"))
            hit = here if hit is None else hit.join(here, ["story_id", "col", "pos"])
        ids = hit.select("story_id").distinct()
        found = ids if found is None else found.join(ids, "story_id", "left_semi")
    return found


def matches_in(stories: DataFrame, query: str, columns: tuple[str, ...] = ("title", "url", "original_text", "romanized_text")) -> DataFrame:
    """``matches`` without a stored index: only rows that hold every token somewhere as plain text get postings, so
    the texts are read once and few are cut. A stored index serves many queries; this one serves one."""
    import re

    df = stories
    for token in {t for t in re.split(r"[\W_]+", query.lower()) if t}:
        df = df.where(reduce(or_, [F.coalesce(F.lower(c), F.lit("")).contains(token) for c in columns]))
    return matches(postings(df, columns), query)


def search(stories: DataFrame, index: DataFrame, query: str) -> DataFrame:
    return stories.join(matches(index, query), "story_id", "left_semi")


def accepted(stories: DataFrame, story_ids: list[int]) -> DataFrame:
    """The table after these rows are accepted by hand: only rows whose text is exact change."""
    ok = F.col("story_id").isin(story_ids) & (F.col("integrity_exact") == 1)
    return (
        stories.withColumn("manual_accept", F.when(ok, 1).otherwise(F.col("manual_accept")))
        .withColumn("review_reason", F.when(ok, "").otherwise(F.col("review_reason")))
        .withColumn("source_changed", F.when(ok, 0).otherwise(F.col("source_changed")))
        .withColumn("status", F.when(ok, "verified").otherwise(F.col("status")))
    )


#: What only the first row of a url sets; later rows of the ingest log leave it alone.
KEPT = ("series_title", "part_number", "category", "category_source", "category_locked", "organized_file", "added_at")


def upserted(stories: DataFrame) -> DataFrame:
    """The ingest log folded on url, with all its columns: the last row of each url, but KEPT from the first.

    An upsert clears ``error`` and ``manual_accept`` where the last row isn't failed. Rows without a url take no part.
    """
    df = stories.where("url is not null")
    rest = [c for c in df.columns if c not in KEPT and c != "url"]
    last, first = F.max_by(F.struct(*rest), "story_id").alias("_l"), F.min_by(F.struct(*KEPT), "story_id").alias("_f")
    out = df.groupBy("url").agg(last, first).select("url", "_l.*", "_f.*")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    out = out.withColumn("error", F.when(failed, F.col("error")).otherwise("")).withColumn("manual_accept", F.when(failed, F.col("manual_accept")).otherwise(0))
    return out.select(*stories.columns)


def failures_recorded(stories: DataFrame, failed: DataFrame) -> DataFrame:
    """A failure (url, error, at) overwrites only status, error and time of its story."""
    f = failed.groupBy("url").agg(F.max_by(F.struct("error", "at"), "at").alias("_f"))
    out = stories.select("story_id", "url", "status", "error", "updated_at").join(f, "url", "left")
    hit = F.col("_f").isNotNull()
    return out.select("story_id", "url", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("_f.error")).otherwise(F.col("error")).alias("error"), F.when(hit, F.col("_f.at")).otherwise(F.col("updated_at")).alias("updated_at"))


def source_changes(stories: DataFrame) -> DataFrame:
    """(story_id, changed): a row whose hash differs from the row of its url before it, both known,
    where that one was verified or in review. Grouped by url, so a window of the few rows of one url."""
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy("story_id")
    df = stories.where("url is not null").select("story_id", "url", "raw_sha256", "status")
    before = F.lag(F.struct("raw_sha256", "status")).over(w)
    df = df.withColumn("_b", before)
    changed = F.coalesce((F.col("_b.raw_sha256") != "") & (F.col("raw_sha256") != "") & (F.col("_b.raw_sha256") != F.col("raw_sha256")) & F.col("_b.status").isin("verified", "review"), F.lit(False))
    return df.select("story_id", changed.cast("int").alias("changed"))


def unchanged(stories: DataFrame, version: int) -> DataFrame:
    """Rows that a run may skip: same hash as the last one of their url, this version, status fine, artifact there."""
    return stories.where((F.col("formatter_version") == version) & F.col("status").isin("verified", "review") & (F.col("formatted_file") != "") & (F.col("raw_sha256") != "") & (F.col("source_changed") == 0))


def backfilled(stories: DataFrame) -> DataFrame:
    return stories.withColumn("added_at", F.when(F.coalesce("added_at", F.lit("")) == "", F.col("updated_at")).otherwise(F.col("added_at")))


def unorganized(stories: DataFrame) -> DataFrame:
    """Stories that have a text but no place yet."""
    return stories.where(F.col("status").isin("verified", "review") & (F.coalesce("organized_file", F.lit("")) == ""))


def preferred(stories: DataFrame) -> DataFrame:
    """(story_id, kind): what a reader is shown: romanized before formatted before raw."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return stories.select("story_id", F.when(has("romanized_file"), "romanized").when(has("formatted_file"), "formatted").when(has("raw_file"), "raw").otherwise("none").alias("kind"))


def summary(stories: DataFrame, recent: int = 8) -> DataFrame:
    return ordered(stories, "newest").limit(recent)
