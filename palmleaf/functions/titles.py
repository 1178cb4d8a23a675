"""Series parts in titles, file-system names and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palmleaf.functions.text import collapse

UNTITLED = "Untitled Story"
_LABELLED = r"(?i)^(.*?)\s*[-–—|:/]?\s*[(\[]?\s*(?:part|pt\.?)\s*[-:#.]?\s*(\d{1,4})\s*[)\]]?$"
_BARE = r"^(.*\D)(\d{1,3})$"
_OTHER_UNIT = r"(?i)\b(?:chapter|chap|ch|episode|ep|season|volume|vol|book)[\s.]*$"
_EDGE = r"^[ \-–—|:/._]+|[ \-–—|:/._]+$"


def series(title: Column) -> Column:
    """struct(base, part): the series that a title names and its number, or the title and NULL.

    ``... Part 3``, ``(Pt. 3)`` and a bare number of up to three digits at the end
    count; chapters, episodes, seasons, volumes and books don't, nor does a number under 1.
    """
    t = collapse(F.coalesce(title, F.lit("")))
    strip = lambda c: F.regexp_replace(c, _EDGE, "")
    base1, n1 = strip(F.regexp_extract(t, _LABELLED, 1)), F.regexp_extract(t, _LABELLED, 2)
    raw2, n2 = F.regexp_extract(t, _BARE, 1), F.regexp_extract(t, _BARE, 2)
    base2 = strip(raw2)
    one = (n1 != "") & (base1 != "") & (n1.cast("int") >= 1)
    two = (n2 != "") & (base2 != "") & ~strip(raw2).rlike(_OTHER_UNIT) & (F.when(n2 != "", n2.cast("int")) >= 1)
    none = F.struct(F.when(t == "", UNTITLED).otherwise(t).alias("base"), F.lit(None).cast("int").alias("part"))
    return (
        F.when(one, F.struct(base1.alias("base"), F.when(n1 != "", n1.cast("int")).alias("part")))
        .when(two, F.struct(base2.alias("base"), F.when(n2 != "", n2.cast("int")).alias("part")))
        .otherwise(none)
    )


#: Names that a file system reserves.
_RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def component(name: Column, fallback: str, limit: int = 120) -> Column:
    """A name that every file system takes: no reserved characters, single blanks, at most ``limit`` long."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x{00}-\x{1f}]', " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    t = F.when(t.rlike(_RESERVED), F.concat(F.lit("_"), t)).otherwise(t)
    t = F.regexp_replace(F.left(t, F.lit(limit)), r"[ .]+$", "")
    return F.when(t == "", fallback).otherwise(t)


#: Messages that a retry can't mend, and those that it may.
PERMANENT = r"(?i)\b404\b|not found|\b410\b|\bgone\b|invalid content|no article|captcha"
TRANSIENT = r"(?i)timeout|timed out|time out|\b429\b|too many requests|\b5\d\d\b|connection reset|connection refused|temporarily unavailable|network error"
TRANSIENT_NAMES = r"ECONNRESET|ETIMEDOUT|EAI_AGAIN"


def error_class(error: Column) -> Column:
    """permanent, transient or unknown; permanent is tested first."""
    e = F.coalesce(error, F.lit(""))
    return F.when(e.rlike(PERMANENT), "permanent").when(e.rlike(TRANSIENT) | e.rlike(TRANSIENT_NAMES), "transient").otherwise("unknown")


def retryable(error: Column) -> Column:
    return error_class(error) != "permanent"
