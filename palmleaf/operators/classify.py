"""Categories by text: aliases, title before body, one category for a whole series, locks."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions.text import fold_title
from palmleaf.functions.titles import series

UNKNOWN = "Uncategorized"
SOURCE_RANK = {"manual": -1, "title": 0, "content": 1, "none": 2}


def clean_categories(names: list[str], limit: int = 200) -> list[str]:
    """Configured names, cleaned, the first of each spelling."""
    out: dict[str, str] = {}
    for n in names:
        n = " ".join(str(n).split()).strip(" .")
        if n:
            out.setdefault(n.casefold(), n)
    return list(out.values())[:limit]


def clean_aliases(given: dict[str, list[str] | str] | list[str], categories: list[str]) -> dict[str, list[str]]:
    """Aliases of known categories, from a map or from lines ``Name = a, b``; a name is no alias of itself."""
    if isinstance(given, list):
        given = dict(x.split("=", 1) for x in given if "=" in x)
    known = {c.casefold(): c for c in categories}
    out: dict[str, list[str]] = {}
    for name, terms in given.items():
        c = known.get(" ".join(name.split()).casefold())
        if c is None:
            continue
        parts = re.split(r"[,|]", terms) if isinstance(terms, str) else terms
        cleaned = clean_categories(list(parts), 50)
        out[c] = [t for t in cleaned if t.casefold() != c.casefold()]
    return out


def _term(term: str) -> str:
    low = term.lower()
    return r"(?<![\p{L}\p{N}_])" + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", low) + r"(?![\p{L}\p{N}_])"


def match(text: Column, categories: list[str], aliases: dict[str, list[str]]) -> Column:
    """The first configured category that the text names as a whole word, by itself or an alias, else NULL.

    A chain of conditions on one lower-cased text that stays in generated code. A term is looked for as plain text first; its
    pattern is tried only where it occurs.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for c in categories:
        hit = reduce(or_, [low.contains(t.lower()) & low.rlike(_term(t)) for t in [c, *aliases.get(c, [])]])
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return F.lit(None).cast("string") if out is None else out


def classified(stories: DataFrame, categories: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(story_id, category, category_source): any hit in the title beats every hit in the texts."""
    aliases = aliases or {}
    body = F.concat_ws("\n", "original_text", "formatted_text", "romanized_text")
    df = stories.withColumn("_t", match(F.col("title"), categories, aliases))
    df = df.select("story_id", "_t", F.when(F.col("_t").isNull(), match(body, categories, aliases)).alias("_b"))
    return df.select("story_id", F.coalesce("_t", "_b", F.lit(UNKNOWN)).alias("category"), F.when(F.col("_t").isNotNull(), "title").when(F.col("_b").isNotNull(), "content").otherwise("none").alias("category_source"))


def consensus(stories: DataFrame, found: DataFrame, categories: list[str]) -> DataFrame:
    """(story_id, category, category_source) after one category was chosen for each series.

    A locked part decides for its series, then the best source, the configured order, the title
    and the id. Series are aggregated and joined back, so no series is gathered in a window.
    """
    order = F.coalesce(F.element_at(F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))]), F.col("category")), F.lit(10**9)) if categories else F.lit(10**9)
    df = stories.select("story_id", "title", "series_title", "part_number", F.col("category").alias("_own"), "category_locked").join(found, "story_id")
    locked = F.col("category_locked") == 1
    df = df.withColumn("category", F.when(locked, F.col("_own")).otherwise(F.col("category"))).withColumn("category_source", F.when(locked, "manual").otherwise(F.col("category_source")))
    rank = F.when(F.col("category_source") == "manual", -1).when(F.col("category_source") == "title", 0).when(F.col("category_source") == "content", 1).otherwise(2)
    series = F.when(F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != ""), fold_title(F.col("series_title")))
    df = df.withColumn("_series", series)
    key = F.struct(rank.alias("r"), order.alias("o"), F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.col("story_id").alias("i"))
    best = df.where("_series is not null").groupBy("_series").agg(F.min_by(F.struct("category", "category_source"), key).alias("_best"))
    out = df.join(best, "_series", "left")
    return out.select("story_id", F.coalesce("_best.category", "category").alias("category"), F.coalesce("_best.category_source", "category_source").alias("category_source"))


def affected(stories: DataFrame, changed: DataFrame) -> DataFrame:
    """(story_id): rows to classify anew: the changed ones and all parts of their series."""
    key = F.when(F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != ""), fold_title(F.col("series_title")))
    df = stories.select("story_id", key.alias("_s"))
    hit = df.join(changed.select("story_id"), "story_id", "left_semi")
    wide = df.join(hit.where("_s is not null").select("_s").distinct(), "_s", "left_semi").select("story_id")
    return hit.select("story_id").unionByName(wide).distinct()


def bulk_category(stories: DataFrame, chosen: DataFrame, category: str | None) -> DataFrame:
    """(story_id, category, category_source, category_locked) after a category was set by hand for a
    selection and its series, or, with None, after their locks were released."""
    hit = affected(stories, chosen).withColumn("_hit", F.lit(True))
    df = stories.select("story_id", "category", "category_source", "category_locked").join(hit, "story_id", "left")
    on = F.col("_hit").isNotNull()
    if category is None:
        return df.select("story_id", "category", F.when(on & (F.col("category_locked") == 1), "none").otherwise(F.col("category_source")).alias("category_source"), F.when(on, 0).otherwise(F.col("category_locked")).alias("category_locked"))
    return df.select("story_id", F.when(on, category).otherwise(F.col("category")).alias("category"), F.when(on, "manual").otherwise(F.col("category_source")).alias("category_source"), F.when(on, 1).otherwise(F.col("category_locked")).alias("category_locked"))


def recomputed(stories: DataFrame, changed: DataFrame, categories: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(story_id, series_title, part_number, category, category_source, category_locked) of the rows that a change touches.

    A changed row gets its series and part from its title, and its category anew unless it is locked. A series in
    which a part changed gets one category: that of its first locked part, which locks all, else the best source, then the
    configured order, then the smallest id among its finished parts. Series are aggregated and joined back.
    """
    hit = changed.select("story_id").distinct().withColumn("_hit", F.lit(True))
    df = stories.select("story_id", "status", "title", "series_title", "part_number", "category", "category_source", "category_locked").join(hit, "story_id", "left")
    df = df.join(classified(stories, categories, aliases).select("story_id", F.col("category").alias("_c"), F.col("category_source").alias("_s")), "story_id")
    on, locked = F.col("_hit").isNotNull(), F.coalesce(F.col("category_locked") == 1, F.lit(False))
    df = df.withColumn("_n", series(F.col("title"))).withColumn("series_title", F.when(on, F.col("_n.base")).otherwise(F.col("series_title"))).withColumn("part_number", F.when(on, F.col("_n.part")).otherwise(F.col("part_number")))
    df = df.withColumn("category", F.when(on & ~locked, F.col("_c")).otherwise(F.col("category"))).withColumn("category_source", F.when(on & ~locked, F.col("_s")).otherwise(F.col("category_source")))
    df = df.withColumn("_key", F.when(F.col("part_number").isNotNull(), F.lower("series_title")))
    touched = df.where(on & F.col("_key").isNotNull()).select("_key").distinct()
    done = df.where(F.col("status").isin("verified", "review")).join(touched, "_key", "left_semi")
    order = F.coalesce(F.element_at(F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))]), F.col("_c")), F.lit(10**9)) if categories else F.lit(10**9)
    rank = F.when(F.col("_s") == "title", 0).when(F.col("_s") == "content", 1).otherwise(2)
    best = done.groupBy("_key").agg(
        F.min_by(F.struct(F.col("_c").alias("c"), F.col("_s").alias("s"), F.lit(0).alias("l")), F.struct(rank.alias("r"), order.alias("o"), F.col("story_id").alias("i"))).alias("_best"),
        F.min_by(F.struct(F.col("category").alias("c"), F.lit("manual").alias("s"), F.lit(1).alias("l")), F.when(locked, F.col("story_id"))).alias("_lock"),
    ).select("_key", F.coalesce("_lock", "_best").alias("_g"))
    out = df.join(best, "_key", "left").where(on | F.col("_g").isNotNull())
    pick = lambda c, x: F.when(F.col("_g").isNotNull(), F.col(f"_g.{x}")).otherwise(F.col(c)).alias(c)
    lock = F.when(F.col("_g.l") == 1, 1).otherwise(F.col("category_locked")).alias("category_locked")
    return out.select("story_id", "series_title", "part_number", pick("category", "c"), pick("category_source", "s"), lock)
