"""Readers of link files, site lists, manifests, journals, sitemaps and lexicons; writers of pages."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("link", "url", "href", "source_url", "title", "name")])
_GROUP = T.StructType([T.StructField(c, T.StringType()) for c in ("main_site", "site", "url")] + [T.StructField("sublinks", T.ArrayType(_ENTRY))])
_STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("title", T.StringType()), T.StructField("words", T.LongType()), T.StructField("html_file", T.StringType())])


def _first(*cols):
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def site_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, pos) of a text list: blank lines and ``#`` comments go, the first of equal lines stays."""
    df = spark.read.text(path).select(F.trim("value").alias("url"), F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("_o"))
    return df.where("url <> '' and not startswith(url, '#')").groupBy("url").agg(F.min("_o").alias("_o")).select("url", F.col("_o.i").alias("pos"))


def link_file(spark: SparkSession, path: str) -> DataFrame:
    """(source, url, title, pos) of a discovery file: one group or a list of them; entries without an http url go."""
    raw = spark.read.text(path, wholetext=True)
    groups = F.coalesce(F.from_json("value", T.ArrayType(_GROUP)), F.array(F.from_json("value", _GROUP)))
    df = raw.select(F.posexplode(groups).alias("_g", "g")).where("g is not null")
    source = F.coalesce(_first(F.col("g.main_site"), F.col("g.site"), F.col("g.url")), F.concat(F.lit("Source "), (F.col("_g") + 1).cast("string")))
    df = df.select(source.alias("source"), "_g", F.posexplode("g.sublinks").alias("_p", "e"))
    url = _first(F.col("e.link"), F.col("e.url"))
    out = df.select("source", url.alias("url"), F.coalesce(_first(F.col("e.title"), F.col("e.name")), url).alias("title"), (F.col("_g").cast("long") * 1_000_000_000 + F.col("_p")).alias("pos"))
    return out.where(F.col("url").rlike(r"^(?i)https?://[^/?#]+"))


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, pos) of a file with one url or JSON object per line; the first of equal urls stays."""
    df = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("pos"))
    e = F.when(F.startswith("v", F.lit("{")), F.from_json("v", _ENTRY))
    url = F.coalesce(_first(e["link"], e["url"], e["href"], e["source_url"]), F.when(~F.startswith("v", F.lit("{")), F.col("v")))
    df = df.select(url.alias("url"), _first(e["title"], e["name"]).alias("title"), "pos").where(F.col("url").rlike(r"^(?i)https?://[^/?#]+"))
    return df.groupBy("url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))


def manifest(spark: SparkSession, path: str, backup: str | None = None) -> DataFrame:
    """(url, status, error, title, words, html_file) of a manifest of version 1; an unreadable one gives way to its backup, then to nothing."""
    schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("pages", T.MapType(T.StringType(), _STATE))])

    def read(p):
        df = spark.read.text(p, wholetext=True).select(F.from_json("value", schema).alias("m")).where("m.version = 1 and m.pages is not null")
        return df.select(F.explode("m.pages").alias("url", "s")).select("url", "s.*")

    if not backup:
        return read(path)
    try:
        df = read(path)
        if df.take(1):
            return df
    except (AnalysisException, Py4JJavaError):
        pass  # the manifest is missing or can't be read: its backup holds
    return read(backup)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(url, state, seq) of an append-only journal of JSON lines; broken lines go.

    ``seq`` orders the log whatever its files and splits are: (file, start of the split, place in it). A journal of
    several files is in the order of their names.
    """
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("state", _STATE)])
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    df = df.select(F.from_json("value", schema).alias("r"), F.struct("file", "start", "at").alias("seq"))
    return df.select("r.*", "seq").where("url is not null and state is not null")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(kind, url) of sitemap files, gzip or plain: kind is urlset or sitemapindex."""
    raw = spark.read.text(path, wholetext=True)
    kind = F.regexp_extract("value", r"<(?:\w+:)?(urlset|sitemapindex)\b", 1)
    locs = F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1))
    return raw.select(kind.alias("kind"), F.explode(locs).alias("url")).where("kind <> ''").select("kind", F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, latin) of a lexicon: word and spelling between a tab, two blanks or ``=``; the last line of a word counts."""
    df = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("pos")).where("v <> '' and not startswith(v, '#')")
    cut = F.split("v", r"\t|\s{2,}|=", 2)
    df = df.where(F.size(cut) == 2).select(F.trim(cut[0]).alias("word"), F.trim(cut[1]).alias("latin"), "pos")
    return df.groupBy("word").agg(F.max_by("latin", "pos").alias("latin"))


def text_tree(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of a folder of texts, one row per file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, pos) of a JSON file of urls in arrays of any depth, as texts or objects; the first of equal urls stays."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    level, found = raw.select("v", F.lit("").alias("at")), None
    while True:  # arrays in arrays; each round opens one level, until none is left
        items = level.where("schema_of_variant(v) like 'ARRAY%'").selectExpr("at", "posexplode(cast(v as array<variant>)) as (p, x)")
        level = items.select(F.col("x").alias("v"), F.concat("at", F.format_string("%09d/", "p")).alias("at"))
        leaf = level.where("schema_of_variant(v) not like 'ARRAY%'")
        found = leaf if found is None else found.unionByName(leaf)
        if level.where("schema_of_variant(v) like 'ARRAY%'").isEmpty():
            break
    get = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')")
    url = F.coalesce(_first(get("link"), get("url"), get("href"), get("source_url")), F.expr("case when schema_of_variant(v) = 'STRING' then cast(v as string) end"))
    df = found.select(url.alias("url"), _first(get("title"), get("name")).alias("title"), F.col("at").alias("pos")).where(F.col("url").rlike(r"^(?i)https?://[^/?#]+"))
    return df.groupBy("url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))


def file_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, token, size): modification time and size of each file, which tell whether it changed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return df.select("path", F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("token"), F.col("length").alias("size"))


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) below a path."""
    df = file_tokens(spark, path).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return df.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines, one per row."""
    results.write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """(category, path, article): one folder per category, pages as rows of text."""
    pages.write.mode("overwrite").partitionBy("category").parquet(path)
