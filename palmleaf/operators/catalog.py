"""Series, the reader's catalog, organised paths, snapshot diffs and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.text import epoch, fold_title
from palmleaf.functions.titles import component, series
from palmleaf.functions.urls import stable_id


def titled(stories: DataFrame) -> DataFrame:
    """(story_id, base, part) read from the titles."""
    return stories.select("story_id", series(F.col("title")).alias("_s")).select("story_id", "_s.base", "_s.part")


def series_list(stories: DataFrame) -> DataFrame:
    """(series, part_count, max_part, missing): parts present and the numbers up to the last that are not.

    A part that came several times counts once; only finished stories count.
    """
    df = stories.where(F.col("status").isin("verified", "review") & F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != ""))
    g = df.groupBy(fold_title(F.col("series_title")).alias("series")).agg(F.array_sort(F.collect_set("part_number")).alias("_p"), F.max("part_number").cast("long").alias("max_part"))
    missing = F.when(F.col("max_part") > 1, F.array_except(F.sequence(F.lit(1), (F.col("max_part") - 1).cast("int")), F.col("_p"))).otherwise(F.array().cast("array<int>"))
    return g.select("series", F.size("_p").cast("long").alias("part_count"), "max_part", F.array_join(F.transform(F.array_sort(missing), lambda x: x.cast("string")), ",").alias("missing"))


def paths(stories: DataFrame) -> DataFrame:
    """(story_id, path) of finished stories: category/series/Part NNN.html or category/title.html.

    Where paths agree without case, all but the first (by title, then id) get a suffix of six
    characters of their url's hash. Collisions are few rows each, so the window is small.
    """
    df = stories.where(F.col("status").isin("verified", "review") & F.col("url").isNotNull())
    cat = component(F.col("category"), "Uncategorized")
    title = component(F.col("title"), "Untitled Story")
    multi = F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != "")
    stem = F.when(multi, F.concat(cat, F.lit("/"), component(F.col("series_title"), "Untitled Series"), F.lit("/Part "), F.lpad(F.col("part_number").cast("string"), 3, "0"))).otherwise(F.concat(cat, F.lit("/"), title))
    df = df.select("story_id", "url", F.lower(F.coalesce("title", F.lit(""))).alias("_t"), stem.alias("_stem"))
    w = Window.partitionBy(F.lower("_stem")).orderBy("_t", "story_id")
    again = F.row_number().over(w) > 1
    return df.select("story_id", F.concat("_stem", F.when(again, F.concat(F.lit(" ["), F.left(F.sha1("url"), F.lit(6)), F.lit("]"))).otherwise(""), F.lit(".html")).alias("path"))


def path_conflicts(stories: DataFrame) -> DataFrame:
    """(organized_file, n): stored paths that several urls claim."""
    df = stories.where("organized_file <> ''").groupBy("organized_file").agg(F.count_distinct("url").alias("n"))
    return df.where("n > 1")


def catalog(stories: DataFrame) -> DataFrame:
    """One row per series or single story: (id, title, category, added_at, parts, n_parts).

    ``parts`` is JSON, ordered by number and url; id and category are those of part one or else the lowest.
    """
    df = stories.where(F.col("status").isin("verified", "review") & F.col("url").isNotNull())
    multi = F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != "")
    last = df.groupBy("url").agg(F.max_by(F.struct("title", "category", "added_at", "part_number", "series_title"), "story_id").alias("_l")).select("url", "_l.*")
    key = F.when(multi, F.concat(F.lit("s:"), fold_title(F.col("series_title")))).otherwise(F.concat(F.lit("u:"), F.col("url")))
    rows = last.select("url", "category", key.alias("_k"), F.when(multi, F.col("series_title")).otherwise(F.coalesce("title", F.lit(""))).alias("_t"), F.when(multi, F.col("part_number")).otherwise(1).alias("_n"), epoch(F.col("added_at")).alias("_a"), F.when(multi, "series").otherwise("story").alias("_kind"))
    anchor = F.min_by(F.struct("url", "category", "_t", "_kind"), F.struct((F.col("_n") != 1).alias("o"), F.col("_n"), F.col("url"))).alias("_x")
    g = rows.groupBy("_k").agg(anchor, F.max("_a").alias("added_at"), F.array_sort(F.collect_list(F.struct(F.col("_n").alias("number"), F.col("url").alias("url")))).alias("_p"))
    ident = F.when(F.col("_x._kind") == "series", stable_id("series", F.col("_x.url"))).otherwise(stable_id("story", F.col("_x.url")))
    return g.select(ident.alias("id"), F.col("_x._t").alias("title"), F.col("_x.category").alias("category"), "added_at", F.to_json("_p").alias("parts"), F.size("_p").cast("long").alias("n_parts"))


def totals(cat: DataFrame) -> DataFrame:
    return cat.agg(F.count(F.lit(1)).alias("story_count"), F.coalesce(F.sum("n_parts"), F.lit(0)).cast("long").alias("part_count"))


def fingerprints(cat: DataFrame) -> DataFrame:
    return cat.select("id", F.left(F.sha2("parts", 256), F.lit(12)).alias("fingerprint"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed or updated between two tables of fingerprints."""
    both = old.select("id", F.col("fingerprint").alias("_o")).join(new.select("id", F.col("fingerprint").alias("_n")), "id", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "updated")
    return both.select("id", change.alias("change")).where("change is not null")


#: Fixed value: so many ids of each change a report lists.
LISTED = 200


def change_report(changes: DataFrame) -> DataFrame:
    """(change, n, ids): how many entries (id, change) were added, updated and removed, all three listed, and the
    first LISTED ids of each in order. Only these ids are gathered: each task keeps its smallest ones."""
    kinds = changes.sparkSession.createDataFrame([("added",), ("updated",), ("removed",)], "change string")
    counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("change").orderBy("id")
    first = changes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= LISTED).groupBy("change").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    out = kinds.join(counts, "change", "left").join(first, "change", "left")
    return out.select("change", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit("")).alias("ids"))


def missing_files(stories: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, file, story_id): files that a row names but the listing (stage, name) doesn't have.

    Formatted, romanized and organized files are due only for finished stories.
    """
    done = F.col("status").isin("verified", "review")
    named = F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.when(F.lit(k == "raw") | done, F.coalesce(F.col(f"{k}_file"), F.lit(""))).otherwise("").alias("name")) for k in ("raw", "formatted", "romanized", "organized")]))
    refs = stories.select("story_id", named).where("name <> ''")
    out = refs.join(files.select("stage", "name").distinct(), ["stage", "name"], "left_anti")
    return out.select(F.concat(F.lit("missing_"), "stage", F.lit("_file")).alias("kind"), F.col("name").alias("file"), "story_id")


def orphan_files(stories: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, file): files of the listing that no row names."""
    named = F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.coalesce(F.col(f"{k}_file"), F.lit("")).alias("name")) for k in ("raw", "formatted", "romanized", "organized")]))
    refs = stories.select(named).where("name <> ''").distinct()
    return files.select("stage", "name").distinct().join(refs, ["stage", "name"], "left_anti").select(F.concat(F.lit("orphan_"), "stage", F.lit("_file")).alias("kind"), F.col("name").alias("file"))


def issues(*parts: DataFrame) -> DataFrame:
    """Issues by kind."""
    out = None
    for p in parts:
        p = p.select("kind")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def repaired(stories: DataFrame, known: DataFrame, journal: DataFrame) -> DataFrame:
    """One row (indexed_rows, organized, links_synced): what a repair rebuilds from the tables.

    The search index anew from all rows, the state of every link that the journal names, and the
    place of every finished story. Each part is a plan of its own, so a run that was lost is simply run again.
    """
    indexed = stories.agg(F.count(F.lit(1)).alias("indexed_rows"))
    organized = paths(stories).agg(F.count(F.lit(1)).alias("organized"))
    urls = known.select("url").distinct().join(journal.where("url is not null").select("url").distinct(), "url", "left_semi")
    return indexed.crossJoin(organized).crossJoin(urls.agg(F.count(F.lit(1)).alias("links_synced")))  # one row each
