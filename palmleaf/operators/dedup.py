"""Three passes over the story table: exact, by title or part, and by similar titles."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions.text import fold_title

RATIO, BUCKET_WORDS, BUCKET_ROWS = 0.88, 30, 40
#: Rows in a block of a large bucket.
BLOCK_ROWS = 500


def exact(stories: DataFrame) -> DataFrame:
    """(raw_sha256, n, first_id): contents that several urls have; a missing hash equals nothing."""
    df = stories.where("raw_sha256 <> '' and url is not null").groupBy("raw_sha256").agg(F.count_distinct("url").alias("n"), F.min("story_id").alias("first_id"))
    return df.where("n > 1")


def flagged(stories: DataFrame) -> DataFrame:
    """(url): urls of the groups of equal contents, titles and parts."""
    df = stories.where("url is not null")
    same = df.join(exact(stories).select("raw_sha256"), "raw_sha256", "left_semi").select("url")
    kind, key = title_key()
    named = df.select("url", kind.alias("kind"), key.alias("key")).where("key <> ''").join(by_title(stories).select("kind", "key"), ["kind", "key"], "left_semi").select("url")
    return same.unionByName(named).distinct()


def title_key() -> tuple[Column, Column]:
    """The kind and key under which the second pass compares a row: its title, or its series and part."""
    single = F.col("part_number").isNull()
    part = F.concat_ws("#", fold_title(F.col("series_title")), F.col("part_number").cast("string"))
    return F.when(single, "title").otherwise("part"), F.when(single, fold_title(F.col("title"))).otherwise(part)


def by_title(stories: DataFrame) -> DataFrame:
    """(kind, key, urls): titles of single stories, and parts of one series, that several urls have."""
    kind, key = title_key()
    df = stories.where("url is not null").select(kind.alias("kind"), key.alias("key"), "url").where("key <> ''")
    return df.groupBy("kind", "key").agg(F.count_distinct("url").alias("urls")).where("urls > 1")


def part_clashes(stories: DataFrame) -> DataFrame:
    """(series, part_number, n): numbers that a series has more than once among finished stories."""
    df = stories.where(F.col("status").isin("verified", "review") & F.col("part_number").isNotNull() & (F.coalesce("series_title", F.lit("")) != ""))
    return df.groupBy(F.lower("series_title").alias("series"), "part_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def similar_titles(stories: DataFrame, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """(a, b, ratio): single stories in one bucket of word counts whose titles are nearly equal.

    Urls that the first two passes flagged take no part. By definition of the report a
    bucket above BUCKET_ROWS is skipped (``skipped_buckets`` counts them), which bounds the
    join within a bucket; with ``bucket_rows`` None every bucket is compared. The ratio depends on the order, which is that of the ids.
    """
    left, _ = _buckets(stories, bucket_rows)
    b = left.select("bucket", F.col("story_id").alias("b"), F.col("title").alias("tb"), F.col("key").alias("kb"))
    pairs = left.select("bucket", F.col("story_id").alias("a"), F.col("title").alias("ta"), F.col("key").alias("ka")).join(b, "bucket").where("a < b and ka <> kb")
    la, lb = F.length("ka"), F.length("kb")
    pairs = pairs.where(2.0 * F.least(la, lb) >= RATIO * (la + lb))

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            f = f[["a", "b"]].assign(ratio=[round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(f["ka"], f["kb"])])
            yield f[f["ratio"] >= RATIO]

    return pairs.select("a", "b", "ka", "kb").mapInPandas(ratio, "a long, b long, ratio double")


def all_similar_titles(stories: DataFrame) -> DataFrame:
    """(a, b, ratio): ``similar_titles`` with every bucket of word counts compared, the large ones too.

    A ratio counts the characters that match twice over both lengths, and no character matches more
    often than both titles have it. So a title that reaches RATIO with another one holds all but a bounded number of
    the characters of both: lengths and counts of characters filter the pairs without losing any.
    Equal titles are gone by then. A bucket is cut into blocks of BLOCK_ROWS, and every two blocks are a task of their own.
    """
    df, sizes = _buckets(stories, None)
    df = df.select("story_id", "key", "bucket").join(sizes, "bucket").withColumn("_s", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    df = df.withColumn("_own", F.pmod(F.xxhash64("story_id"), F.col("_s")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    df = df.select("bucket", F.least("_own", "_o").alias("i"), F.greatest("_own", "_o").alias("j"), "_own", "story_id", "key")
    return df.groupBy("bucket", "i", "j").applyInPandas(_compare_block, "a long, b long, ratio double")


def _compare_block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("story_id", ignore_index=True)
    keys, ids, own = frame["key"].tolist(), frame["story_id"].to_numpy(), frame["_own"].to_numpy()
    one_block = frame["i"].iloc[0] == frame["j"].iloc[0]
    chars = {c: k for k, c in enumerate(sorted(set("".join(keys))))}
    counts = np.zeros((len(keys), len(chars)), np.int16)
    for row, key in zip(counts, keys):
        for c in key:
            row[chars[c]] += 1
    length = counts.sum(1, dtype=np.int64)
    out = []
    match = SequenceMatcher(None)
    for y in range(1, len(keys)):
        least = (RATIO - 5e-5) * (length[:y] + length[y])  # the ratio is rounded to four places before it is compared
        x = np.flatnonzero((2 * np.minimum(length[:y], length[y]) >= least) & (one_block | (own[:y] != own[y])))
        x = x[2 * np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) >= least[x] - 1e-9]
        if len(x):
            match.set_seq2(keys[y])  # prepared once for all that it is compared with
        for k in x:
            if keys[k] != keys[y]:
                match.set_seq1(keys[k])
                ratio = round(match.ratio(), 4)
                if ratio >= RATIO:
                    out.append((ids[k], ids[y], ratio))
    return pd.DataFrame(out, columns=["a", "b", "ratio"])


def _buckets(stories: DataFrame, bucket_rows: int | None = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    df = stories.where("part_number is null and url is not null").select("story_id", "url", "title", "raw_sha256", fold_title(F.col("title")).alias("key"), F.floor(F.coalesce("words", F.lit(0)) / BUCKET_WORDS).cast("long").alias("bucket")).where("key <> ''")
    df = df.join(flagged(stories), "url", "left_anti")
    sizes = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    if bucket_rows is None:
        return df, sizes
    return df.join(sizes.where(F.col("n") <= bucket_rows).select("bucket"), "bucket", "left_semi"), sizes


def skipped_buckets(stories: DataFrame) -> DataFrame:
    """(skipped_buckets, skipped_stories) of the pass on similar titles."""
    _, sizes = _buckets(stories)
    return sizes.where(F.col("n") > BUCKET_ROWS).agg(F.count(F.lit(1)).alias("skipped_buckets"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("skipped_stories"))


def report(stories: DataFrame) -> DataFrame:
    """(kind, groups, urls) of the first two passes, and of all their groups (``all``), whose urls count once."""
    one = exact(stories).select(F.lit("exact").alias("kind"), F.col("n").alias("urls"))
    two = by_title(stories).select("kind", "urls")
    groups = one.unionByName(two)
    total = groups.agg(F.count(F.lit(1)).alias("groups")).crossJoin(flagged(stories).agg(F.count(F.lit(1)).alias("urls")))  # one row each
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("urls").alias("urls")).unionByName(total.select(F.lit("all").alias("kind"), "groups", "urls"))
