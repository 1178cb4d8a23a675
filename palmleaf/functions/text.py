"""Whitespace, entities, case and marks: scalar functions on text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the 29 characters that count as white space.
BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    def rounds(x):
        if x is None:
            return None
        for _ in range(3):
            y = html.unescape(x)
            if y == x:
                break
            x = y
        return x

    return text.map(rounds)


def decode_entities(text: Column) -> Column:
    """HTML entities decoded until nothing changes, three rounds at most; texts without ``&`` stay in the JVM."""
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)


def normal_text(text: Column) -> Column:
    """Entities decoded, white space collapsed: what a lossless rewrite must keep."""
    return collapse(decode_entities(text))


def fold_title(title: Column) -> Column:
    """Titles compare without case and with single blanks."""
    return F.lower(collapse(F.coalesce(title, F.lit(""))))


def word_count(text: Column) -> Column:
    """Pieces between white space; 0 for a missing text."""
    t = collapse(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def has_telugu(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{0C00}-\x{0C7F}]"), F.lit(False))


def escape_html(text: Column) -> Column:
    """The five characters that markup reserves, as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def contains_fold(text: Column, wanted: str) -> Column:
    """Literal search without case; wildcards are ordinary characters."""
    return F.coalesce(F.lower(text), F.lit("")).contains(wanted.lower())


def sentences(text: Column) -> Column:
    """Pieces after ``. ! ? … ।`` and white space."""
    return F.split(text, rf"(?<=[.!?…।])[{BLANK}]+")


def epoch(text: Column) -> Column:
    """Seconds since 1970 of a text timestamp in any of its notations, UTC where it names no zone; 0 if unreadable."""
    return F.greatest(F.lit(0), F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0)))
