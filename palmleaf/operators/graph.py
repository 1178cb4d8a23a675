"""Bounded breadth-first search over a static graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.session import stage


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of what can be reached from the seeds (url, depth) along edges (src, dst).

    One join per level, the frontier against the edges; each level is written to the
    shared folder, so the plan doesn't grow with the depth. ``max_pages`` keeps the nearest, then smallest urls.
    """
    seen = stage(seeds.groupBy("url").agg(F.min("depth").cast("int").alias("depth")), "seen")
    start = seen.agg(F.min("depth")).first()[0]
    if start is None:
        return seen
    for depth in range(start, max_depth):
        front = seen.where(F.col("depth") == depth).select("url")
        found = front.join(edges.select(F.col("src").alias("url"), "dst"), "url").select(F.col("dst").alias("url")).distinct()
        new = stage(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1)), "level")
        if not new.take(1):
            if seen.where(F.col("depth") > depth).take(1):
                continue
            break
        seen = stage(seen.unionByName(new), "seen")
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen


def replayed(journal: DataFrame) -> DataFrame:
    """(url, state) of a crawl's journal (seq, t, url, links): v records are visited pages with their
    links, sitemap records list urls, done ends a run. A url is visited, or queued if it was only seen.
    Records before the last start belong to an older run."""
    start = journal.where("t = 'start'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_s"))
    now = journal.crossJoin(F.broadcast(start)).where("seq >= _s")  # one row
    visited = now.where("t = 'v' and url is not null").select("url").distinct()
    seen = now.where("t in ('v', 'sitemap', 'start')").select(F.explode(F.coalesce("links", F.array().cast("array<string>"))).alias("url")).distinct()
    return visited.withColumn("state", F.lit("visited")).unionByName(seen.join(visited, "url", "left_anti").withColumn("state", F.lit("queued")))
