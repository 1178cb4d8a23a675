"""Settings of a run: clamped numbers, site profiles, names of pages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values: (default, least, most) of each numeric setting.
LIMITS = {
    "page_limit": (1000, 1, 250_000),
    "concurrency": (3, 1, 8),
    "delay_ms": (500, 0, 60_000),
    "page_length": (50, 10, 100),
    "auto_batch": (20, 1, 200),
}


def clamp(value: Column, name: str) -> Column:
    """A setting given as text: the default if unreadable, else within its bounds."""
    default, least, most = LIMITS[name]
    return F.least(F.greatest(F.coalesce(value.try_cast("double").cast("long"), F.lit(default)), F.lit(least)), F.lit(most))


def site_profiles(text: str, most: float = 60.0) -> dict[str, float]:
    """Seconds of delay by host from lines ``host = seconds``; ``#`` lines and bad numbers are skipped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        host, number = line.split("=", 1)
        try:
            out[host.strip().lower()] = min(most, max(0.0, float(number)))
        except ValueError:
            continue
    return out


@F.pandas_udf(StringType())
def _ascii_slug(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not "̀" <= c <= "ͯ")
        return re.sub(r"[\W_]+", "-", t).strip("-")[:70].strip("-")

    return text.map(one)


def slug(title: Column) -> Column:
    """Letters and numbers of a title joined by ``-``, without Latin accents, at most 70 characters."""
    return _ascii_slug(title)


def page_stem(title: Column, url: Column) -> Column:
    """The file stem of a page: its slug and twelve characters of its url's hash."""
    return F.concat_ws("-", F.nullif(slug(title), F.lit("")), F.left(F.sha2(url, 256), F.lit(12)))


def stem_matches(file: Column, url: Column) -> Column:
    """Whether a file name ends with the hash of a url."""
    return F.endswith(file, F.concat(F.lit("-"), F.left(F.sha2(url, 256), F.lit(12)), F.lit(".html")))
