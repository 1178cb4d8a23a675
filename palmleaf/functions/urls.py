"""URL canonicalisation, scope and host functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query fields that only track visitors.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "gclid", "fbclid", "msclkid",
    "mc_cid", "mc_eid", "ref", "ref_src", "refsrc", "igshid", "spm", "_ga", "yclid", "vero_id",
)
#: Extensions of downloads that hold no page.
DOWNLOADS = (
    "7z", "avi", "bmp", "css", "csv", "doc", "docx", "eot",
    "epub", "exe", "gif", "gz", "ico", "jpeg", "jpg", "js",
    "json", "m4a", "m4v", "mkv", "mov", "mp3", "mp4", "mpeg",
    "ogg", "ogv", "otf", "pdf", "png", "ppt", "pptx", "rar",
    "rss", "svg", "tar", "tgz", "tif", "tiff", "ttf", "wav",
    "webm", "webp", "woff", "woff2", "xls", "xlsx", "xml", "zip",
)

_WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)\??([^#]*)(?:#.*)?\z"


def bare(url: Column) -> Column:
    """A url without white space around it."""
    return F.regexp_replace(url, r"^\s+|\s+\z", "")


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of a url without white space around it."""
    return F.regexp_extract(bare(url), _WHOLE, i)


def library_key(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """The key of the link table: scheme and authority in lower case, an empty path as ``/``,
    no slash at its end, no tracking fields, fields in order of name and value, no fragment.

    Escapes stay as they are; a field without ``=`` reads as one with an empty value.
    """
    def build(p: Column) -> Column:
        path = F.regexp_replace(F.get(p, F.lit(2)), r"/+\z", "")
        fields = F.transform(F.filter(F.split(F.get(p, F.lit(3)), "&"), lambda f: f != ""), lambda f: F.split(f, "=", 2))
        pairs = F.transform(fields, lambda f: F.struct(F.get(f, F.lit(0)).alias("k"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("v")))
        kept = F.array_sort(F.filter(pairs, lambda f: ~F.lower(f["k"]).isin(*tracking)))
        query = F.array_join(F.transform(kept, lambda f: F.concat(f["k"], F.lit("="), f["v"])), "&")
        whole = F.concat(F.lower(F.get(p, F.lit(0))), F.lit("://"), F.lower(F.get(p, F.lit(1))), F.when(path == "", "/").otherwise(path), F.regexp_replace(F.concat(F.lit("?"), query), r"^\?\z", ""))
        return F.when(F.size(p) == 4, whole).when(p.isNotNull(), ":///")

    # the url is cut once; the array of one binds its pieces to a name
    pieces = F.split(F.regexp_replace(bare(url), _WHOLE, "$1\ue000$2\ue000$3\ue000$4"), "\ue000")
    return F.element_at(F.transform(F.array(pieces), build), 1)


def crawl_key(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """The key of a crawl: as above, but default ports go, ``.`` and ``..`` and repeated
    slashes resolve, and a slash at the end stays. NULL for anything but http and https."""
    scheme = F.lower(part(url, 1))
    host = F.lower(part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    raw = part(url, 3)
    steps = F.filter(F.split(raw, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    walk = F.aggregate(steps, empty, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    path = F.concat(F.lit("/"), F.array_join(walk, "/"), F.when(raw.endswith("/") & (F.size(walk) > 0), "/").otherwise(""))
    query = F.regexp_extract(library_key(url, tracking), r"\?(.*)$", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def page_key(url: Column) -> Column:
    """The key of an extractor: without its fragment; NULL for anything but http and https."""
    t = bare(url)
    return F.when(t.rlike(r"^(?i)https?://[^/?#]"), F.regexp_replace(t, r"(?s)#.*\z", ""))


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^.*@", "")
    return F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(h, r":\d*\z", ""))


def in_scope(url: Column, root: str, subdomains: bool = False) -> Column:
    """Whether a url lies under a root: same host (or one below it) and a path under the root's."""
    u = F.lit(root)
    same = host(url) == host(u)
    if subdomains:
        same = same | F.endswith(host(url), F.concat(F.lit("."), host(u)))
    base = F.concat(F.regexp_replace(part(u, 3), r"/+\z", ""), F.lit("/"))
    return same & F.startswith(F.concat(F.regexp_replace(part(url, 3), r"/+\z", ""), F.lit("/")), base)


def is_page(url: Column) -> Column:
    """Whether the path doesn't end like a download."""
    path = F.lower(F.coalesce(F.try_url_decode(part(url, 3)), part(url, 3)))
    return ~path.rlike(r"\.(" + "|".join(DOWNLOADS) + ")$")


def title_from(url: Column) -> Column:
    """The last step of the path with blanks for ``-`` and ``_``, else the url."""
    last = F.element_at(F.split(F.regexp_replace(part(url, 3), r"/+\z", ""), "/"), -1)
    t = F.trim(F.regexp_replace(last, r"[-_]+", " "))
    return F.when(t == "", bare(url)).otherwise(t)


def stable_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(url, 256), F.lit(16)))
