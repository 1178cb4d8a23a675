"""Duplicates hidden by formatting differences in a log of links.

Method: byte-identical urls collapse first, with counts; only the distinct
survivors are canonicalised; their canonical texts are grouped again and the
counts summed. Everything is built from JVM-side expressions.

Nulls and blanks: a row without a url (NULL or only blanks) is no page and is
left out. A broken escape keeps the literal text of its part. Extra columns of the input
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many urls can each hold this share of all rows, so the table of hot urls is bounded.
HOT_SHARE = 1 / 5_000

_SEP, _EQ = "\x01", "\x02"


def _decode(part: Column, plus: bool) -> Column:
    ready = part if plus else F.regexp_replace(part, r"\+", "%2B")
    return F.when(part.contains("%") | (F.lit(plus) & part.contains("+")), F.coalesce(F.try_url_decode(ready), part)).otherwise(part)


_BLANK = r"\s\x{a0}\x{2000}-\x{200b}\x{feff}\x{3000}"


def with_canonical(df: DataFrame, url_col: str, tracking: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: text that is equal for two urls exactly if they name one page.

    Ignored: blanks around, case of scheme and host, port 443 on https, slashes
    at the end of the path, fragment, empty pieces of the query, tracking
    fields, order of the fields, and escapes against literal characters.
    A field without ``=`` equals the field with an empty value. ``out`` is NULL for
    a blank url. Each step is a projection of its own, so no expression is computed twice.
    """

    def field(piece: Column) -> Column:
        name = F.split_part(piece, F.lit("="), F.lit(1))
        value = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.struct(_decode(name, plus=True).alias("n"), _decode(value, plus=True).alias("v"))

    df = df.withColumn("_bare", F.regexp_replace(url_col, rf"^[{_BLANK}]+|[{_BLANK}]+$", ""))
    # scheme, host, path, ?, query; the fragment goes with the text that is replaced
    df = df.withColumn("_part", F.split(F.regexp_replace("_bare", r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)\??([^#]*)(?:#.*)?$", "$1\x01$2\x01$3\x01$4"), _SEP))
    df = df.withColumn("_fields", F.transform(F.filter(F.split(F.get("_part", F.lit(3)), "&"), lambda p: p != ""), field))
    df = df.withColumn("_fields", F.array_sort(F.filter("_fields", lambda f: ~F.lower(f["n"]).isin(tracking))))
    scheme, host = F.lower(F.get("_part", F.lit(0))), F.lower(F.get("_part", F.lit(1)))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(_decode(F.get("_part", F.lit(2)), plus=True), r"/+$", "")
    texts = F.transform("_fields", lambda f: F.concat(f["n"], F.lit(_EQ), f["v"]))
    page = F.concat_ws(_SEP, scheme, host, path, F.array_join(texts, "&" + _SEP))
    df = df.withColumn(out, F.when(F.col("_bare") == "", None).when(F.size("_part") == 4, page).otherwise(F.concat(F.lit(_SEP), "_bare")))
    return df.drop("_bare", "_part", "_fields")


def pages(links: DataFrame, tracking: list[str], id_col: str = "link_id", url_col: str = "url") -> DataFrame:
    """(canonical, first_id, n): one record per page, its smallest id and the number of its rows."""
    raw = links.where(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("_url")).agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (
        with_canonical(raw, "_url", tracking, "canonical")
        .where(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(F.min("_first").alias("first_id"), F.sum("_n").alias("n"))
    )


def copies(links: DataFrame, tracking: list[str], id_col: str = "link_id", url_col: str = "url") -> DataFrame:
    """(link_id_first, link_id_copy) for every row that is not the first of its page.

    The raw urls are keyed by 128 bits of hash, so text is never shuffled twice.
    A url that alone holds more than HOT_SHARE of all rows is joined by
    broadcast; by that share there are at most 1 / HOT_SHARE of them. All other
    rows take an ordinary shuffled join.
    """
    rows = links.where(F.col(url_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    raw = rows.groupBy("_url").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # two independent hashes stand for the texts from here on
    two = lambda c: (F.xxhash64(c).alias("_k1"), F.xxhash64(F.lit("b"), c).alias("_k2"))
    keyed = with_canonical(raw.select("_url", *two(F.col("_url")), "_first", "_n"), "_url", tracking, "_c").where("_c is not null")
    keyed = keyed.select("_k1", "_k2", "_first", "_n", F.xxhash64("_c").alias("_c1"), F.xxhash64(F.lit("b"), "_c").alias("_c2"))
    return _paired(rows, keyed, two)


def _paired(rows: DataFrame, keyed: DataFrame, two) -> DataFrame:
    from palmleaf.session import stage

    keyed = stage(keyed, "distinct_urls")
    total = keyed.agg(F.sum("_n")).first()[0] or 0
    firsts = keyed.groupBy("_c1", "_c2").agg(F.min("_first").alias("link_id_first"), F.sum("_n").alias("_all"))
    firsts = firsts.where("_all > 1").drop("_all")
    to_first = keyed.join(firsts, ["_c1", "_c2"]).select("_k1", "_k2", "_n", "_first", "link_id_first")
    # a url that stands alone needs no join with the log: its only row is its first
    single = to_first.where("_n = 1 and _first <> link_id_first").select("link_id_first", F.col("_first").alias("link_id_copy"))
    many = to_first.where("_n > 1")
    limit = max(1.0, total * HOT_SHARE)
    log = rows.select("_id", *two(F.col("_url")))
    hot = F.broadcast(many.where(F.col("_n") > limit).select("_k1", "_k2", "link_id_first"))
    cold = many.where(F.col("_n") <= limit).select("_k1", "_k2", "link_id_first")
    joined = log.join(hot, ["_k1", "_k2"]).unionByName(log.join(cold, ["_k1", "_k2"]))
    found = joined.where("_id <> link_id_first").select("link_id_first", F.col("_id").alias("link_id_copy"))
    return single.unionByName(found).select(F.col("link_id_first").cast("long"), F.col("link_id_copy").cast("long"))
