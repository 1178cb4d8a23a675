"""All queries of the engine's own operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import text as X
from palmleaf.functions import titles as T
from palmleaf.functions import phonetic, settings, translit, urls
from palmleaf.operators import catalog, classify, dedup, graph, htmlpage, library, links, schema, segment
from palmleaf.session import table

CATEGORIES = ["Ghost", "Humour", "College", "Work", "Family", "Travel", "Mystery", "Village"]
ALIASES = {"Ghost": ["haunted"], "Travel": ["ferry", "night train"], "College": ["hostel"], "Work": ["office"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _t(spark, d, name):
    return table(spark, d, name)


# Fixed expressions of DuckDB that several twins share.
_TRACK = ", ".join(f"'{k}'" for k in urls.TRACKING)
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_bare(u: str) -> str:
    return f"regexp_replace({u}, '^\\s+|\\s+$', '', 'g')"


def _sql_part(u: str, i: int) -> str:
    return f"regexp_extract({_sql_bare(u)}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)\\??([^#]*)(?:#(?s:.*))?$', {i})"


def _sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _sql_plain(c: str) -> str:
    """Entities of the test data decoded, up to three rounds as the operator does."""
    for _ in range(3):
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
            c = f"replace({c}, '{entity}', '{sign}')"
    return _sql_collapse(c)


def _sql_fold(c: str) -> str:
    return f"lower({_sql_collapse(f"coalesce({c}, '')")})"


def _sql_epoch(c: str) -> str:
    zoned = f"CASE WHEN regexp_matches({c}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {c} ELSE {c} || '+00:00' END"
    return f"greatest(0, coalesce(CAST(floor(epoch(try_cast({zoned} AS TIMESTAMPTZ))) AS BIGINT), 0))"


def _sql_pairs(q: str) -> str:
    return f"""list_sort(list_filter(list_transform(list_filter(string_split({q}, '&'), lambda f: f <> ''),
        lambda f: {{'k': split_part(f, '=', 1), 'v': substr(f, length(split_part(f, '=', 1)) + 2)}}), lambda p: lower(p.k) NOT IN ({_TRACK})))"""


def _sql_key(u: str) -> str:
    p = _sql_part(u, 3)
    path = f"CASE WHEN regexp_replace({p}, '/+$', '') = '' THEN '/' ELSE regexp_replace({p}, '/+$', '') END"
    qs = f"array_to_string(list_transform({_sql_pairs(_sql_part(u, 4))}, lambda p: p.k || '=' || p.v), '&')"
    return f"lower({_sql_part(u, 1)}) || '://' || lower({_sql_part(u, 2)}) || {path} || CASE WHEN coalesce({qs}, '') <> '' THEN '?' || {qs} ELSE '' END"


_HOST = f"regexp_replace(regexp_replace(lower({_sql_part('url', 2)}), '^.*@', ''), ':\\d*$', '')"
_PERM = r"(?i)\b404\b|not found|\b410\b|\bgone\b|invalid content|no article|captcha"
_TRANS = r"(?i)timeout|timed out|time out|\b429\b|too many requests|\b5\d\d\b|connection reset|connection refused|temporarily unavailable|network error"
_CLASS = f"CASE WHEN regexp_matches(coalesce(error, ''), '{_PERM}') THEN 'permanent' WHEN regexp_matches(coalesce(error, ''), '{_TRANS}') OR regexp_matches(coalesce(error, ''), 'ECONNRESET|ETIMEDOUT|EAI_AGAIN') THEN 'transient' ELSE 'unknown' END"
_DONE = "status IN ('verified', 'review')"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return links.first_of_each(_t(spark, d, "links"))


# --- links: counts, lists, retries, canonical keys ---------------------------------------------------------


@query("q1_links_by_status", "SELECT status, count(*) AS n FROM links GROUP BY status")
def _(s, d):
    return links.count_by_status(_t(s, d, "links"))


@query(
    "q2_links_by_source",
    """SELECT source, count(*) AS links, count(*) FILTER (status = 'scraped') AS scraped, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'pending') AS pending, CAST(floor(100.0 * count(*) FILTER (status = 'scraped') / count(*) + 0.5) AS BIGINT) AS percent FROM links GROUP BY source""",
)
def _(s, d):
    return links.count_by_source(_t(s, d, "links"))


@query("q3_links_page", f"SELECT link_id, url, title, status FROM links WHERE status = 'pending' AND (contains(lower(coalesce(title, '')), 'kettle') OR contains(lower(coalesce(url, '')), 'kettle')) ORDER BY {_sql_epoch('discovered_at')} DESC, link_id DESC LIMIT 50")
def _(s, d):
    return links.listed(_t(s, d, "links"), status="pending", wanted="kettle").select("link_id", "url", "title", "status")


@query("q4_links_retryable", f"SELECT link_id, error FROM links WHERE status = 'failed' AND {_CLASS} <> 'permanent'")
def _(s, d):
    return links.failed_retryable(_t(s, d, "links")).select("link_id", "error")


@query("q11_links_requeued", f"SELECT link_id, CASE WHEN status = 'failed' AND {_CLASS} <> 'permanent' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND {_CLASS} <> 'permanent' THEN '' ELSE error END AS error FROM links")
def _(s, d):
    return links.requeued(_t(s, d, "links")).select("link_id", "status", "error")


@query("q22_links_first_of_key", f"SELECT key, arg_min(url, link_id) AS url, min(link_id) AS link_id, count(*) AS n FROM (SELECT *, {_sql_key('url')} AS key FROM links WHERE url IS NOT NULL) GROUP BY key")
def _(s, d):
    return links.first_of_each(_t(s, d, "links"))


@query(
    "q22_links_new",
    f"""WITH k AS (SELECT *, {_sql_key('url')} AS key FROM links WHERE url IS NOT NULL), st AS (SELECT DISTINCT {_sql_key('url')} AS key FROM stories WHERE url IS NOT NULL)
    SELECT key, arg_min(url, link_id) AS url, min(link_id) AS link_id, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM st) GROUP BY key""",
)
def _(s, d):
    known = _t(s, d, "stories").where("url is not null").select(urls.library_key(F.col("url")).alias("key"))
    return links.new_against(_t(s, d, "links"), known)


@query("p1_library_key", f"SELECT link_id, {_sql_key('url')} AS key FROM links")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.library_key(F.col("url")).alias("key"))


@query("p2_crawl_key")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.crawl_key(F.col("url")).alias("key"))


@query("p3_page_key", f"SELECT link_id, CASE WHEN regexp_matches({_sql_bare('url')}, '^(?i)https?://[^/?#]') THEN regexp_replace({_sql_bare('url')}, '#(?s:.*)$', '') END AS key FROM links")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.page_key(F.col("url")).alias("key"))


@query("p4_in_scope", f"SELECT link_id, {_HOST} = 'lantern-serials.example' AND starts_with(regexp_replace({_sql_part('url', 3)}, '/+$', '') || '/', '/story/') AS in_scope FROM links")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.in_scope(F.col("url"), "https://lantern-serials.example/story").alias("in_scope"))


_EXT = "|".join(urls.DOWNLOADS)


@query("p5_is_page", f"SELECT link_id, NOT regexp_matches(lower(url_decode({_sql_part('url', 3)})), '\\.({_EXT})$') AS is_page FROM links")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.is_page(F.col("url")).alias("is_page"))


_LAST = f"trim(regexp_replace(list_last(string_split(regexp_replace({_sql_part('url', 3)}, '/+$', ''), '/')), '[-_]+', ' ', 'g'))"


@query("p6_title_from_url", f"SELECT link_id, CASE WHEN url IS NULL THEN NULL WHEN {_LAST} = '' THEN {_sql_bare('url')} ELSE {_LAST} END AS title FROM links")
def _(s, d):
    return _t(s, d, "links").select("link_id", urls.title_from(F.col("url")).alias("title"))


@query("p7_hosts", f"SELECT {_HOST} AS host, count(*) AS n FROM links WHERE url IS NOT NULL GROUP BY 1")
def _(s, d):
    return links.hosts(_t(s, d, "links"))


@query("s3_host_delays", f"SELECT host, CAST(CASE WHEN host = 'lantern-serials.example' THEN 2000 ELSE 500 END AS BIGINT) AS delay_ms FROM (SELECT DISTINCT {_HOST} AS host FROM links WHERE url IS NOT NULL)")
def _(s, d):
    return links.delays(_t(s, d, "links"), s.createDataFrame([("lantern-serials.example", 2000)], "host string, delay_ms int"))


@query("p19_error_class", f"SELECT link_id, {_CLASS} AS error_class FROM links")
def _(s, d):
    return links.with_error_class(_t(s, d, "links")).select("link_id", "error_class")


@query("p19_error_class_counts", f"SELECT {_CLASS} AS error_class, count(*) AS n FROM (SELECT error FROM links UNION ALL SELECT error FROM stories) GROUP BY 1")
def _(s, d):
    both = _t(s, d, "links").select("error").unionByName(_t(s, d, "stories").select("error"))
    return both.groupBy(T.error_class(F.col("error")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


# --- journal and runs -----------------------------------------------------------------------------------


_FOLD = """SELECT url, CASE arg_max(state.status, seq) WHEN 'success' THEN 'scraped' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS status,
    coalesce(arg_max_null(state.error, seq), '') AS error, count(*) FILTER (state.status = 'failed') AS retries
    FROM fetch_journal WHERE url IS NOT NULL AND state IS NOT NULL AND state.status IS NOT NULL GROUP BY url"""


@query("st3_journal_fold", _FOLD)
def _(s, d):
    return links.fold_journal(_t(s, d, "fetch_journal"))


@query("st4_journal_replay", "SELECT url, max(seq) AS seq, arg_max(coalesce(state.status, ''), seq) AS status FROM fetch_journal WHERE url IS NOT NULL GROUP BY url")
def _(s, d):
    return links.last_states(_t(s, d, "fetch_journal"))


@query(
    "st2_reconciled",
    """WITH j AS (SELECT url, seq, state.status AS status, state.error AS error FROM fetch_journal WHERE url IS NOT NULL AND state.status IS NOT NULL),
    h AS (SELECT max(seq) // 2 AS m FROM fetch_journal),
    snap AS (SELECT url, -1 AS seq, arg_max(status, seq) AS status, arg_max_null(error, seq) AS error, true AS snap FROM j, h WHERE seq <= m GROUP BY url),
    b AS (SELECT * FROM snap UNION ALL SELECT url, seq, status, error, false FROM j, h WHERE seq > m)
    SELECT url, CASE arg_max(status, seq) WHEN 'success' THEN 'scraped' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS status, coalesce(arg_max_null(error, seq), '') AS error,
    count(*) FILTER (status = 'failed' AND NOT snap) + max(CASE WHEN status = 'failed' AND snap THEN 1 ELSE 0 END) AS retries FROM b GROUP BY url""",
)
def _(s, d):
    j = _t(s, d, "fetch_journal")
    half = (j.agg(F.max("seq")).first()[0] or 0) // 2
    snap = j.where(f"url is not null and state.status is not null and seq <= {half}").groupBy("url").agg(F.max_by(F.struct("state.status", "state.error"), "seq").alias("_l")).select("url", "_l.*")
    return links.reconcile(snap, j, half)


@query(
    "st3_links_applied",
    f"""WITH f AS ({_FOLD}) SELECT l.link_id, l.url, coalesce(f.status, l.status) AS status, coalesce(f.error, l.error) AS error, CAST(l.retry_count + coalesce(f.retries, 0) AS BIGINT) AS retry_count
    FROM links l LEFT JOIN f ON l.url = f.url""",
)
def _(s, d):
    return links.applied(_t(s, d, "links"), links.fold_journal(_t(s, d, "fetch_journal")))


@query("st9_pending_urls", f"WITH f AS ({_FOLD}) SELECT DISTINCT url FROM links WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM f WHERE status = 'scraped')")
def _(s, d):
    return links.pending_of(_t(s, d, "links"), links.fold_journal(_t(s, d, "fetch_journal")), retry_failed=True)


@query("st6_micro_batch", f"WITH f AS ({_FOLD}) SELECT url, min(link_id) AS link_id FROM links WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM f WHERE status <> 'pending') GROUP BY url ORDER BY link_id LIMIT 200")
def _(s, d):
    return links.micro_batch(_t(s, d, "links"), links.fold_journal(_t(s, d, "fetch_journal")))


@query("s18_results", f"WITH f AS ({_FOLD}) SELECT link_id, coalesce(f.status, 'not_processed') AS status FROM links LEFT JOIN f USING (url)")
def _(s, d):
    return links.results(_t(s, d, "links"), links.fold_journal(_t(s, d, "fetch_journal")))


@query("a5_run_summary", f"WITH f AS ({_FOLD}) SELECT coalesce(f.status, 'not_processed') AS status, count(*) AS n FROM links LEFT JOIN f USING (url) GROUP BY 1")
def _(s, d):
    return links.results(_t(s, d, "links"), links.fold_journal(_t(s, d, "fetch_journal"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("q25_latest_value", "SELECT name, arg_max(state, id) AS state FROM job_runs WHERE name IS NOT NULL GROUP BY name")
def _(s, d):
    return links.latest_value(_t(s, d, "job_runs"), "name", "state", "id")


@query("q19_run_history", "SELECT id, name, state FROM job_runs ORDER BY id DESC LIMIT 20")
def _(s, d):
    return links.run_history(_t(s, d, "job_runs")).select("id", "name", "state")


@query("q21_interrupted", "SELECT id, CASE WHEN state = 'running' THEN 'interrupted' ELSE state END AS state, CASE WHEN state = 'running' AND coalesce(error, '') = '' THEN 'interrupted by restart' ELSE error END AS error FROM job_runs")
def _(s, d):
    return links.interrupted(_t(s, d, "job_runs")).select("id", "state", "error")


@query("q28_beyond_newest", "SELECT id, name FROM job_runs QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) > 2")
def _(s, d):
    return links.keep_newest(_t(s, d, "job_runs"), "name", "id", 2).select("id", "name")


@query("q20_run_states", "SELECT state, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM job_runs GROUP BY state")
def _(s, d):
    return _t(s, d, "job_runs").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("q20_runs_folded", "SELECT id, name, command, state, started_at, CASE WHEN state = 'running' THEN '' ELSE coalesce(finished_at, '') END AS finished_at, CASE WHEN state = 'running' THEN NULL ELSE exit_code END AS exit_code, CASE WHEN state = 'running' THEN '' ELSE coalesce(error, '') END AS error FROM job_runs WHERE id IS NOT NULL")
def _(s, d):
    return links.runs_folded(links.run_events(_t(s, d, "job_runs")))


# --- the story table ------------------------------------------------------------------------------------


@query("q5_story_counts", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (romanized = 1) AS romanized FROM stories")
def _(s, d):
    return library.counts(_t(s, d, "stories"))


@query("q6_library_newest", f"SELECT story_id, title FROM stories WHERE status = 'verified' AND telugu = 0 ORDER BY {_sql_epoch('updated_at')} DESC, story_id LIMIT 50")
def _(s, d):
    return library.page(_t(s, d, "stories"), "newest", 1, 50, status="verified", language="english").select("story_id", "title")


@query("q6_library_oldest", f"SELECT story_id FROM stories WHERE category = 'Ghost' ORDER BY {_sql_epoch('updated_at')}, story_id LIMIT 50")
def _(s, d):
    return library.page(_t(s, d, "stories"), "oldest", 1, 50, category="Ghost").select("story_id")


@query("q6_library_longest", "SELECT story_id, words FROM stories ORDER BY words DESC NULLS LAST, story_id LIMIT 100 OFFSET 100")
def _(s, d):
    return library.page(_t(s, d, "stories"), "longest", 2, 100).select("story_id", "words")


@query("q6_library_title", "SELECT story_id, title FROM stories WHERE romanized = 1 ORDER BY lower(title) NULLS FIRST, story_id LIMIT 50")
def _(s, d):
    return library.page(_t(s, d, "stories"), "title", 1, 50, language="romanized").select("story_id", "title")


@query("q8_literal_search", "SELECT story_id FROM stories WHERE " + " AND ".join(f"(contains(lower(coalesce(title, '')), '{w}') OR contains(lower(coalesce(url, '')), '{w}') OR contains(lower(coalesce(original_text, '')), '{w}') OR contains(lower(coalesce(romanized_text, '')), '{w}'))" for w in ("velvet", "ferry")))
def _(s, d):
    return library.filtered(_t(s, d, "stories"), wanted="Velvet ferry").select("story_id")


@query(
    "q7_full_text",
    "SELECT story_id FROM stories WHERE "
    + " AND ".join(
        "(" + " OR ".join(f"regexp_matches(coalesce({c}, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}]){w}')" for c in ("title", "url", "original_text", "romanized_text")) + ")"
        for w in (r"velvet([^\p{L}\p{N}]|$)", "lant")
    ),
)
def _(s, d):
    st = _t(s, d, "stories")
    return library.matches_in(st, "velvet lant").select("story_id")


@query("q7_phrase_search", "SELECT story_id FROM stories WHERE " + " OR ".join(f"regexp_matches(coalesce({c}, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}])night[^\\p{{L}}\\p{{N}}]+train')" for c in ("title", "url", "original_text", "romanized_text")))
def _(s, d):
    st = _t(s, d, "stories")
    return library.matches_in(st, "night-train").select("story_id")


@query("st10_postings", "SELECT col, token, count(*) AS n, count(DISTINCT story_id) AS stories FROM (" + " UNION ALL ".join(
    f"SELECT story_id, '{c}' AS col, unnest(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')) AS token FROM stories WHERE {c} IS NOT NULL" for c in ("title", "url", "original_text", "romanized_text")) + ") GROUP BY col, token")
def _(s, d):
    return library.postings(_t(s, d, "stories")).groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("story_id").alias("stories"))


@query("q9_point_lookup", "SELECT story_id, title FROM stories WHERE url = (SELECT url FROM stories WHERE story_id = 7)")
def _(s, d):
    st = _t(s, d, "stories")
    return st.join(st.where("story_id = 7").select("url"), "url", "left_semi").select("story_id", "title")


@query("q10_selected", "SELECT link_id, url FROM links WHERE status = 'pending' AND url IN (SELECT url FROM stories)")
def _(s, d):
    return _t(s, d, "links").where("status = 'pending'").join(_t(s, d, "stories").select("url").distinct(), "url", "left_semi").select("link_id", "url")


_ACC = "(story_id IN (2, 3, 5, 8, 13, 21, 34) AND integrity_exact = 1)"


@query("q12_accepted", f"SELECT story_id, CASE WHEN {_ACC} THEN 'verified' ELSE status END AS status, CASE WHEN {_ACC} THEN 1 ELSE manual_accept END AS manual_accept, CASE WHEN {_ACC} THEN '' ELSE review_reason END AS review_reason, CASE WHEN {_ACC} THEN 0 ELSE source_changed END AS source_changed FROM stories")
def _(s, d):
    return library.accepted(_t(s, d, "stories"), [2, 3, 5, 8, 13, 21, 34]).select("story_id", "status", "manual_accept", "review_reason", "source_changed")


_STORY = [c for c in schema.STORIES.fieldNames() if c not in ("url", "story_id")]


@query(
    "q23_upserted",
    "WITH f AS (SELECT url, max(story_id) AS story_id, " + ", ".join(f"arg_{'min' if c in library.KEPT else 'max'}_null({c}, story_id) AS {c}" for c in _STORY)
    + " FROM stories WHERE url IS NOT NULL GROUP BY url) SELECT * REPLACE (CASE WHEN status = 'failed' THEN error ELSE '' END AS error, CASE WHEN status = 'failed' THEN manual_accept ELSE 0 END AS manual_accept) FROM f",
)
def _(s, d):
    return library.upserted(_t(s, d, "stories"))


@query(
    "q24_failures_recorded",
    """WITH f AS (SELECT url, arg_max_null(coalesce(state.error, ''), seq) AS error, CAST(max(seq) AS VARCHAR) AS at FROM fetch_journal WHERE url IS NOT NULL AND state.status = 'failed' GROUP BY url)
    SELECT story_id, s.url, CASE WHEN f.url IS NOT NULL THEN 'failed' ELSE status END AS status, CASE WHEN f.url IS NOT NULL THEN f.error ELSE s.error END AS error, CASE WHEN f.url IS NOT NULL THEN f.at ELSE updated_at END AS updated_at FROM stories s LEFT JOIN f ON s.url = f.url""",
)
def _(s, d):
    f = _t(s, d, "fetch_journal").where("url is not null and state.status = 'failed'").groupBy("url").agg(F.max_by(F.coalesce("state.error", F.lit("")), "seq").alias("error"), F.max("seq").cast("string").alias("at"))
    return library.failures_recorded(_t(s, d, "stories"), f)


@query(
    "t17_source_changes",
    """WITH w AS (SELECT story_id, raw_sha256, lag(raw_sha256) OVER o AS h, lag(status) OVER o AS st FROM stories WHERE url IS NOT NULL WINDOW o AS (PARTITION BY url ORDER BY story_id))
    SELECT story_id, CASE WHEN coalesce(h <> '' AND raw_sha256 <> '' AND h <> raw_sha256 AND st IN ('verified', 'review'), false) THEN 1 ELSE 0 END AS changed FROM w""",
)
def _(s, d):
    return library.source_changes(_t(s, d, "stories"))


@query("t18_unchanged", f"SELECT story_id FROM stories WHERE formatter_version = 5 AND {_DONE} AND formatted_file <> '' AND raw_sha256 <> '' AND source_changed = 0")
def _(s, d):
    return library.unchanged(_t(s, d, "stories"), 5).select("story_id")


@query("q31_backfilled", "SELECT story_id, CASE WHEN coalesce(added_at, '') = '' THEN updated_at ELSE added_at END AS added_at FROM stories")
def _(s, d):
    return library.backfilled(_t(s, d, "stories")).select("story_id", "added_at")


@query("q17_unorganized", f"SELECT count(*) AS n FROM stories WHERE {_DONE} AND coalesce(organized_file, '') = ''")
def _(s, d):
    return library.unorganized(_t(s, d, "stories")).agg(F.count(F.lit(1)).alias("n"))


@query("q18_table_counts", "SELECT 'links' AS name, count(*) AS n FROM links UNION ALL SELECT 'stories', count(*) FROM stories UNION ALL SELECT 'raw_pages', count(*) FROM raw_pages UNION ALL SELECT 'job_runs', count(*) FROM job_runs")
def _(s, d):
    parts = [_t(s, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("links", "stories", "raw_pages", "job_runs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("q26_to_transliterate", f"SELECT story_id FROM stories WHERE telugu = 1 AND {_DONE}")
def _(s, d):
    return _t(s, d, "stories").where("telugu = 1 and status in ('verified', 'review')").select("story_id")


@query("x6_preferred", "SELECT story_id, CASE WHEN coalesce(romanized_file, '') <> '' THEN 'romanized' WHEN coalesce(formatted_file, '') <> '' THEN 'formatted' WHEN coalesce(raw_file, '') <> '' THEN 'raw' ELSE 'none' END AS kind FROM stories")
def _(s, d):
    return library.preferred(_t(s, d, "stories"))


@query("a3_summary", f"SELECT story_id, title FROM stories ORDER BY {_sql_epoch('updated_at')} DESC, story_id LIMIT 8")
def _(s, d):
    return library.summary(_t(s, d, "stories")).select("story_id", "title")


@query("p21_epoch", f"SELECT story_id, {_sql_epoch('added_at')} AS added_at FROM stories")
def _(s, d):
    return _t(s, d, "stories").select("story_id", X.epoch(F.col("added_at")).alias("added_at"))


@query("p22_stable_id", "SELECT story_id, 'story-' || left(sha256(url), 16) AS id FROM stories WHERE url IS NOT NULL")
def _(s, d):
    return _t(s, d, "stories").where("url is not null").select("story_id", urls.stable_id("story", F.col("url")).alias("id"))


@query("p23_telugu", r"SELECT story_id, regexp_matches(coalesce(original_text, ''), '[\x{0C00}-\x{0C7F}]') AS has_telugu FROM stories")
def _(s, d):
    return _t(s, d, "stories").select("story_id", X.has_telugu(F.col("original_text")).alias("has_telugu"))


@query("p24_word_count", f"SELECT story_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT story_id, {_sql_collapse("coalesce(original_text, '')")} AS t FROM stories)")
def _(s, d):
    return _t(s, d, "stories").select("story_id", X.word_count(F.col("original_text")).cast("long").alias("n"))


@query("p15_fold_title", f"SELECT story_id, {_sql_fold('title')} AS title FROM stories")
def _(s, d):
    return _t(s, d, "stories").select("story_id", X.fold_title(F.col("title")).alias("title"))


# --- titles, series, catalog ------------------------------------------------------------------------------


_EDGE = r"'^[ \-–—|:/._]+|[ \-–—|:/._]+$', '', 'g'"
_LAB = r"'(?i)^(.*?)\s*[-–—|:/]?\s*[(\[]?\s*(?:part|pt\.?)\s*[-:#.]?\s*(\d{1,4})\s*[)\]]?$'"
_UNIT = r"'(?i)\b(?:chapter|chap|ch|episode|ep|season|volume|vol|book)[\s.]*$'"


@query(
    "p10_series_parts",
    f"""WITH t AS (SELECT story_id, {_sql_collapse("coalesce(title, '')")} AS t FROM stories), m AS (SELECT story_id, t,
    regexp_replace(regexp_extract(t, {_LAB}, 1), {_EDGE}) AS b1, try_cast(regexp_extract(t, {_LAB}, 2) AS INTEGER) AS n1,
    regexp_replace(regexp_extract(t, '^(.*\\D)(\\d{{1,3}})$', 1), {_EDGE}) AS b2, try_cast(regexp_extract(t, '^(.*\\D)(\\d{{1,3}})$', 2) AS INTEGER) AS n2 FROM t),
    k AS (SELECT *, coalesce(b1 <> '' AND n1 >= 1, false) AS one, coalesce(b2 <> '' AND n2 >= 1 AND NOT regexp_matches(b2, {_UNIT}), false) AS two FROM m)
    SELECT story_id, CASE WHEN one THEN b1 WHEN two THEN b2 WHEN t = '' THEN 'Untitled Story' ELSE t END AS base, CASE WHEN one THEN n1 WHEN two THEN n2 END AS part FROM k""",
)
def _(s, d):
    return catalog.titled(_t(s, d, "stories"))


@query(
    "a6_series",
    f"""WITH g AS (SELECT {_sql_fold('series_title')} AS series, list_sort(list(DISTINCT part_number)) AS p, CAST(max(part_number) AS BIGINT) AS max_part FROM stories
    WHERE {_DONE} AND part_number IS NOT NULL AND coalesce(series_title, '') <> '' GROUP BY 1)
    SELECT series, len(p) AS part_count, max_part, array_to_string(list_filter(range(1, max_part), lambda x: NOT list_contains(p, x)), ',') AS missing FROM g""",
)
def _(s, d):
    return catalog.series_list(_t(s, d, "stories"))


@query("q15_series_order", f"SELECT DISTINCT {_sql_fold('series_title')} AS series, part_number FROM stories WHERE part_number IS NOT NULL AND coalesce(series_title, '') <> ''")
def _(s, d):
    return _t(s, d, "stories").where("part_number is not null and series_title <> ''").select(X.fold_title(F.col("series_title")).alias("series"), "part_number").distinct().orderBy("series", "part_number")


@query("q16_catalog_rows", f"SELECT story_id, coalesce(part_number, 0) AS part FROM stories WHERE {_DONE}")
def _(s, d):
    return _t(s, d, "stories").where("status in ('verified', 'review')").orderBy(F.lower("category"), F.lower("series_title"), F.coalesce("part_number", F.lit(0)), F.lower("title"), "story_id").select("story_id", F.coalesce("part_number", F.lit(0)).alias("part"))


@query("p9_paths")
def _(s, d):
    return catalog.paths(_t(s, d, "stories"))


@query("q27_path_conflicts", "SELECT organized_file, count(DISTINCT url) AS n FROM stories WHERE organized_file <> '' GROUP BY 1 HAVING count(DISTINCT url) > 1")
def _(s, d):
    return catalog.path_conflicts(_t(s, d, "stories"))


_CAT = f"""last AS (SELECT url, arg_max_null(title, story_id) AS title, arg_max_null(category, story_id) AS category, arg_max_null(added_at, story_id) AS added_at, arg_max_null(part_number, story_id) AS part_number, arg_max_null(series_title, story_id) AS series_title
    FROM stories WHERE {_DONE} AND url IS NOT NULL GROUP BY url),
    r AS (SELECT url, category, part_number IS NOT NULL AND coalesce(series_title, '') <> '' AS multi, CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN 's:' || {_sql_fold('series_title')} ELSE 'u:' || url END AS k,
    CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN series_title ELSE coalesce(title, '') END AS t, CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN part_number ELSE 1 END AS n, {_sql_epoch('added_at')} AS a FROM last),
    x AS (SELECT k, first(url ORDER BY n <> 1, n, url) AS url, first(category ORDER BY n <> 1, n, url) AS category, first(t ORDER BY n <> 1, n, url) AS t, first(multi ORDER BY n <> 1, n, url) AS multi, max(a) AS added_at, count(*) AS n_parts FROM r GROUP BY k)"""


@query("a7_catalog", f"WITH {_CAT} SELECT CASE WHEN multi THEN 'series-' ELSE 'story-' END || left(sha256(url), 16) AS id, t AS title, category, added_at, n_parts FROM x")
def _(s, d):
    return catalog.catalog(_t(s, d, "stories")).select("id", "title", "category", "added_at", "n_parts")


@query("a9_catalog_totals", f"WITH {_CAT} SELECT count(*) AS story_count, CAST(sum(n_parts) AS BIGINT) AS part_count FROM x")
def _(s, d):
    return catalog.totals(catalog.catalog(_t(s, d, "stories")))


@query("a7_catalog_json")
def _(s, d):
    return catalog.catalog(_t(s, d, "stories")).select("id", "parts")


@query(
    "x5_snapshot_diff",
    f"""WITH o AS (SELECT url AS id, arg_max_null(coalesce(raw_sha256, ''), story_id) AS f FROM stories WHERE url IS NOT NULL AND story_id <= (SELECT max(story_id) // 2 FROM stories) GROUP BY url),
    n AS (SELECT url AS id, arg_max_null(coalesce(raw_sha256, ''), story_id) AS f FROM stories WHERE url IS NOT NULL AND story_id > (SELECT max(story_id) // 4 FROM stories) GROUP BY url)
    SELECT id, CASE WHEN o.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'removed' ELSE 'updated' END AS change FROM o FULL OUTER JOIN n USING (id) WHERE o.f IS NULL OR n.f IS NULL OR o.f <> n.f""",
)
def _(s, d):
    st = _t(s, d, "stories").where("url is not null")
    top = _t(s, d, "stories").agg(F.max("story_id")).first()[0] or 0
    snap = lambda df: df.groupBy(F.col("url").alias("id")).agg(F.max_by(F.coalesce("raw_sha256", F.lit("")), "story_id").alias("fingerprint"))
    return catalog.diff(snap(st.where(F.col("story_id") <= top // 2)), snap(st.where(F.col("story_id") > top // 4)))


@query("x5_catalog_fingerprints")
def _(s, d):
    return catalog.fingerprints(catalog.catalog(_t(s, d, "stories")))


_FILES = "(SELECT DISTINCT 'raw' AS stage, raw_file AS name FROM raw_pages WHERE raw_file <> '')"


def _files(s, d):
    return _t(s, d, "raw_pages").where("raw_file <> ''").select(F.lit("raw").alias("stage"), F.col("raw_file").alias("name"))


_REFS = " UNION ALL ".join(f"SELECT '{k}' AS stage, {k}_file AS name, story_id FROM stories WHERE {k}_file <> ''" + ("" if k == "raw" else f" AND {_DONE}") for k in ("raw", "formatted", "romanized", "organized"))


@query("x1_missing_files", f"SELECT 'missing_' || r.stage || '_file' AS kind, r.name AS file, r.story_id FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM {_FILES} f WHERE f.stage = r.stage AND f.name = r.name)")
def _(s, d):
    return catalog.missing_files(_t(s, d, "stories"), _files(s, d))


@query("x2_orphan_files", f"SELECT 'orphan_raw_file' AS kind, name AS file FROM {_FILES} f WHERE name NOT IN (SELECT raw_file FROM stories WHERE raw_file <> '')")
def _(s, d):
    return catalog.orphan_files(_t(s, d, "stories"), _files(s, d))


@query("a4_issues", f"SELECT kind, count(*) AS n FROM (SELECT 'missing_' || r.stage || '_file' AS kind FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM {_FILES} f WHERE f.stage = r.stage AND f.name = r.name) UNION ALL SELECT 'orphan_raw_file' FROM {_FILES} f WHERE name NOT IN (SELECT raw_file FROM stories WHERE raw_file <> '')) GROUP BY kind")
def _(s, d):
    st, f = _t(s, d, "stories"), _files(s, d)
    return catalog.issues(catalog.missing_files(st, f), catalog.orphan_files(st, f))


# --- duplicates -------------------------------------------------------------------------------------------


_D1 = "SELECT raw_sha256, count(DISTINCT url) AS n, min(story_id) AS first_id FROM stories WHERE raw_sha256 <> '' AND url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) > 1"


@query("x4_repaired", f"SELECT count(*) AS indexed_rows, count(*) FILTER ({_DONE} AND url IS NOT NULL) AS organized, (SELECT count(DISTINCT url) FROM links WHERE url IN (SELECT url FROM fetch_journal WHERE url IS NOT NULL)) AS links_synced FROM stories")
def _(s, d):
    return catalog.repaired(_t(s, d, "stories"), _t(s, d, "links"), _t(s, d, "fetch_journal"))


@query("d1_exact", _D1)
def _(s, d):
    return dedup.exact(_t(s, d, "stories"))


_D2 = f"""SELECT kind, key, count(DISTINCT url) AS urls FROM (SELECT 'title' AS kind, {_sql_fold('title')} AS key, url FROM stories WHERE part_number IS NULL AND url IS NOT NULL
    UNION ALL SELECT 'part', {_sql_fold('series_title')} || '#' || CAST(part_number AS VARCHAR), url FROM stories WHERE part_number IS NOT NULL AND url IS NOT NULL) WHERE kind = 'part' OR key <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) > 1"""


@query("d2_titles_and_parts", _D2)
def _(s, d):
    return dedup.by_title(_t(s, d, "stories"))


@query("q14_part_clashes", f"SELECT lower(series_title) AS series, part_number, count(*) AS n FROM stories WHERE {_DONE} AND part_number IS NOT NULL AND coalesce(series_title, '') <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return dedup.part_clashes(_t(s, d, "stories"))


@query("d3_similar_titles")
def _(s, d):
    return dedup.similar_titles(_t(s, d, "stories"))


@query("d3_all_similar_titles")
def _(s, d):
    return dedup.all_similar_titles(_t(s, d, "stories"))


@query("a11_skipped_buckets")
def _(s, d):
    return dedup.skipped_buckets(_t(s, d, "stories"))


_D2_KEY = f"CASE WHEN part_number IS NULL THEN 'title' ELSE 'part' END AS kind, CASE WHEN part_number IS NULL THEN {_sql_fold('title')} ELSE {_sql_fold('series_title')} || '#' || part_number END AS key"


@query(
    "d4_report",
    f"""WITH one AS ({_D1}), two AS ({_D2}), g AS (SELECT 'exact' AS kind, n AS urls FROM one UNION ALL SELECT kind, urls FROM two),
    f AS (SELECT url FROM stories WHERE url IS NOT NULL AND raw_sha256 IN (SELECT raw_sha256 FROM one) UNION SELECT url FROM (SELECT url, {_D2_KEY} FROM stories WHERE url IS NOT NULL) JOIN two USING (kind, key))
    SELECT kind, count(*) AS groups, CAST(sum(urls) AS BIGINT) AS urls FROM g GROUP BY kind UNION ALL SELECT 'all', (SELECT count(*) FROM g), (SELECT count(*) FROM f)""",
)
def _(s, d):
    return dedup.report(_t(s, d, "stories"))


# --- categories -------------------------------------------------------------------------------------------


def _sql_match(c: str) -> str:
    esc = lambda t: "".join("\\" + x if x in "\\^$.|?*+()[]{}" else x for x in t.lower())
    parts = []
    for name in CATEGORIES:
        terms = "|".join(esc(t) for t in [name, *ALIASES.get(name, [])])
        parts.append(f"WHEN regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_])({terms})([^\\p{{L}}\\p{{N}}_]|$)') THEN '{name}'")
    return f"CASE {' '.join(parts)} END"


_BODY = "concat_ws(chr(10), original_text, formatted_text, romanized_text)"
_CLASSIFIED = f"SELECT story_id, coalesce(t, b, 'Uncategorized') AS category, CASE WHEN t IS NOT NULL THEN 'title' WHEN b IS NOT NULL THEN 'content' ELSE 'none' END AS category_source FROM (SELECT story_id, {_sql_match("lower(coalesce(title, ''))")} AS t, {_sql_match(f'lower({_BODY})')} AS b FROM stories)"


@query("t20_classified", _CLASSIFIED)
def _(s, d):
    return classify.classified(_t(s, d, "stories"), CATEGORIES, ALIASES)


_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES)) + " ELSE 1000000000 END"


@query(
    "t21_consensus",
    f"""WITH c AS ({_CLASSIFIED}), k AS (SELECT s.story_id, s.title, CASE WHEN s.category_locked = 1 THEN s.category ELSE c.category END AS category, CASE WHEN s.category_locked = 1 THEN 'manual' ELSE c.category_source END AS category_source,
    CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN {_sql_fold('series_title')} END AS k FROM stories s JOIN c USING (story_id)),
    b AS (SELECT k, first({{'c': category, 's': category_source}} ORDER BY CASE category_source WHEN 'manual' THEN -1 WHEN 'title' THEN 0 WHEN 'content' THEN 1 ELSE 2 END, {_ORDER}, lower(coalesce(title, '')), story_id) AS x FROM k WHERE k IS NOT NULL GROUP BY k)
    SELECT story_id, coalesce(x.c, category) AS category, coalesce(x.s, category_source) AS category_source FROM k LEFT JOIN b USING (k)""",
)
def _(s, d):
    st = _t(s, d, "stories")
    return classify.consensus(st, classify.classified(st, CATEGORIES, ALIASES), CATEGORIES)


@query("t22_recomputed")
def _(s, d):
    st = _t(s, d, "stories")
    return classify.recomputed(st, st.where("source_changed = 1"), CATEGORIES, ALIASES)


@query("t22_affected", f"""WITH k AS (SELECT story_id, source_changed, CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN {_sql_fold('series_title')} END AS k FROM stories)
    SELECT story_id FROM k WHERE source_changed = 1 OR k IN (SELECT k FROM k WHERE source_changed = 1 AND k IS NOT NULL)""")
def _(s, d):
    st = _t(s, d, "stories")
    return classify.affected(st, st.where("source_changed = 1"))


@query("t23_bulk_category", f"""WITH k AS (SELECT *, CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN {_sql_fold('series_title')} END AS k FROM stories),
    h AS (SELECT story_id FROM k WHERE source_changed = 1 OR k IN (SELECT k FROM k WHERE source_changed = 1 AND k IS NOT NULL))
    SELECT story_id, CASE WHEN story_id IN (SELECT story_id FROM h) THEN 'Ghost' ELSE category END AS category, CASE WHEN story_id IN (SELECT story_id FROM h) THEN 'manual' ELSE category_source END AS category_source,
    CASE WHEN story_id IN (SELECT story_id FROM h) THEN 1 ELSE category_locked END AS category_locked FROM stories""")
def _(s, d):
    st = _t(s, d, "stories")
    return classify.bulk_category(st, st.where("source_changed = 1"), "Ghost")


@query("t23_unlocked", f"""WITH k AS (SELECT *, CASE WHEN part_number IS NOT NULL AND coalesce(series_title, '') <> '' THEN {_sql_fold('series_title')} END AS k FROM stories),
    h AS (SELECT story_id FROM k WHERE category_locked = 1 OR k IN (SELECT k FROM k WHERE category_locked = 1 AND k IS NOT NULL))
    SELECT story_id, category, CASE WHEN story_id IN (SELECT story_id FROM h) AND category_locked = 1 THEN 'none' ELSE category_source END AS category_source,
    CASE WHEN story_id IN (SELECT story_id FROM h) THEN 0 ELSE category_locked END AS category_locked FROM stories""")
def _(s, d):
    st = _t(s, d, "stories")
    return classify.bulk_category(st, st.where("category_locked = 1"), None)


# --- text -------------------------------------------------------------------------------------------------


@query("p14_normalised", f"SELECT story_id, sha256({_sql_plain('original_text')}) AS digest FROM stories WHERE original_text IS NOT NULL")
def _(s, d):
    return segment.normalised(_t(s, d, "stories"))


@query("t13_formatted")
def _(s, d):
    return segment.formatted(_t(s, d, "stories"))


@query("t15_fidelity", "SELECT count(*) AS texts, count(*) AS exact FROM stories WHERE original_text IS NOT NULL")
def _(s, d):
    st = _t(s, d, "stories")
    return segment.faithful(st, segment.formatted(st)).agg(F.count(F.lit(1)).alias("texts"), F.sum("exact").alias("exact"))


@query("t14_block_quality")
def _(s, d):
    return segment.block_quality(segment.formatted(_t(s, d, "stories")))


@query(
    "t14_stored_quality",
    f"""WITH b AS (SELECT story_id, list_filter(list_transform(string_split(formatted_text, chr(10)), lambda x: {_sql_collapse('x')}), lambda x: x <> '') AS b FROM stories WHERE formatted_text IS NOT NULL)
    SELECT story_id, len(b) AS paragraphs, CAST(coalesce(list_max(list_transform(b, lambda x: length(x))), 0) AS BIGINT) AS longest FROM b""",
)
def _(s, d):
    done = _t(s, d, "stories").where("formatted_text is not null").select("story_id", F.col("formatted_text").alias("formatted"))
    return segment.block_quality(done).select("story_id", "paragraphs", "longest")


@query("t12_sentences", f"SELECT story_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(regexp_replace(t, '([.!?…।])[\\s]+', '\\1' || chr(1), 'g'), chr(1))) END AS n_sentences FROM (SELECT story_id, {_sql_collapse('original_text')} AS t FROM stories WHERE original_text IS NOT NULL)")
def _(s, d):
    return segment.sentence_counts(_t(s, d, "stories"))


@query("t16_edit_guard", f"SELECT story_id, coalesce({_sql_plain('original_text')} = {_sql_plain('formatted_text')}, false) AS allowed FROM stories WHERE formatted_text IS NOT NULL")
def _(s, d):
    st = _t(s, d, "stories")
    return segment.edit_allowed(st, st.where("formatted_text is not null").select("story_id", F.col("formatted_text").alias("edited")))


_ESC = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("s15_html_sink", f"SELECT story_id, array_to_string(list_transform(list_filter(string_split(formatted_text, chr(10)), lambda x: x <> ''), lambda x: '<p>' || {_ESC} || '</p>'), chr(10)) AS html FROM stories WHERE formatted_text <> ''")
def _(s, d):
    para = F.filter(F.split("formatted_text", "\n"), lambda x: x != "")
    return _t(s, d, "stories").where("formatted_text <> ''").select("story_id", F.array_join(F.transform(para, lambda x: F.concat(F.lit("<p>"), X.escape_html(x), F.lit("</p>"))), "\n").alias("html"))


@query("s15_formatted_html")
def _(s, d):
    done = segment.formatted(_t(s, d, "stories"))
    return done.select("story_id", F.array_join(F.transform(F.filter(F.split("formatted", "\n\n"), lambda x: x != ""), lambda x: F.concat(F.lit("<p>"), X.escape_html(x), F.lit("</p>"))), "\n").alias("html"))


@query("t8_romanized")
def _(s, d):
    return translit.romanized(_t(s, d, "stories"))


@query("t8_vocabulary", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(original_text, '[\x{0C00}-\x{0C7F}\x{200C}\x{200D}]+')) AS word FROM stories WHERE original_text IS NOT NULL) GROUP BY word")
def _(s, d):
    return translit.vocabulary(_t(s, d, "stories"))


@query("t8_transliterated")
def _(s, d):
    return translit.transliterated(translit.vocabulary(_t(s, d, "stories")))


def _loan_words(s, d):
    """(word, latin) of the distinct words that end in a bare consonant, and the ranked English words of the texts."""
    st = _t(s, d, "stories")
    words = translit.transliterated(translit.vocabulary(st).where(F.col("word").rlike(r"^[\x{0C00}-\x{0C7F}]{2,}\x{0C4D}$")))
    tokens = st.where("original_text is not null").select(F.explode(F.split(F.regexp_replace(F.lower("original_text"), "[^a-z]+", " "), " ")).alias("english")).where("length(english) > 2")
    counts = tokens.groupBy("english").agg(F.count(F.lit(1)).alias("n"))
    # the rank of a word is the number of words that are more frequent; counts are few, so their sums are small
    per = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    above = per.alias("a").join(per.alias("b"), F.col("b.n") > F.col("a.n"), "left").groupBy(F.col("a.n").alias("n")).agg(F.coalesce(F.sum("b.k"), F.lit(0)).cast("long").alias("rank"))
    return words, counts.join(above, "n").select("english", "rank")


@query("t8_guesses")
def _(s, d):
    return phonetic.guesses(*_loan_words(s, d))


@query("t8_trusted_spellings")
def _(s, d):
    words, english = _loan_words(s, d)
    corpus = translit.lexicon_votes(_t(s, d, "stories"))
    return phonetic.gated(corpus, translit.transliterated(corpus.select("word", F.col("votes").alias("n"))), phonetic.guesses(words, english))


@query("a10_lexicon_votes")
def _(s, d):
    return translit.lexicon_votes(_t(s, d, "stories"))


# --- pages ------------------------------------------------------------------------------------------------


@query("t1_blocks")
def _(s, d):
    return htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", "title", F.posexplode("blocks").alias("pos", "b")).select("page_id", "title", "pos", "b.kind", "b.text")


@query("t3_links")
def _(s, d):
    return htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.text")


@query("a8_block_statistics")
def _(s, d):
    return htmlpage.block_statistics(htmlpage.parsed(_t(s, d, "raw_pages")))


@query("t7_markdown")
def _(s, d):
    return htmlpage.markdown(htmlpage.parsed(_t(s, d, "raw_pages")))


@query("s16_article_html")
def _(s, d):
    return htmlpage.article_html(htmlpage.parsed(_t(s, d, "raw_pages")))


@query("p27_quality_score")
def _(s, d):
    return htmlpage.quality_score(htmlpage.parsed(_t(s, d, "raw_pages")))


@query("t6_page_titles", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), ''), url, '') AS title FROM raw_pages WHERE html IS NOT NULL")
def _(s, d):
    return htmlpage.page_titles(_t(s, d, "raw_pages"))


@query("p12_page_of_story", "SELECT s.story_id, p.page_id FROM stories s JOIN raw_pages p ON s.raw_file = p.raw_file AND s.raw_sha256 = p.raw_sha256 WHERE s.raw_file <> '' AND s.raw_sha256 <> ''")
def _(s, d):
    return _t(s, d, "stories").where("raw_file <> '' and raw_sha256 <> ''").join(_t(s, d, "raw_pages").select("page_id", "raw_file", "raw_sha256"), ["raw_file", "raw_sha256"]).select("story_id", "page_id")


@query("p26_challenge_pages", "SELECT page_id, " + " OR ".join(f"contains(lower(coalesce(url, '') || chr(10) || left(html, 25000)), '{m}')" for m in ("just a moment", "checking your browser", "verify you are human", "challenges.cloudflare.com", "cf-chl-")) + " AS challenge FROM raw_pages WHERE html IS NOT NULL")
def _(s, d):
    return _t(s, d, "raw_pages").where("html is not null").select("page_id", htmlpage.is_challenge(F.col("url"), F.col("html")).alias("challenge"))


@query("p26_challenge_fixture", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, false)) t(page_id, challenge)")
def _(s, d):
    rows = [(1, "Just a moment...", "<p>x</p>"), (2, None, "<p>Checking your browser</p>"), (3, "A story", "<p>Nobody could verify it.</p>"), (4, "", "<a href='https://challenges.cloudflare.com/x'>"), (5, "late", "x" * 25_000 + "cf-chl-")]
    return s.createDataFrame(rows, "page_id int, title string, html string").select("page_id", htmlpage.is_challenge(F.col("title"), F.col("html")).alias("challenge"))


@query("g1_crawl")
def _(s, d):
    """Pages reached over the log: a source page leads to the urls that it lists."""
    log = _t(s, d, "links").where("url is not null and source is not null")
    edges = log.select(urls.crawl_key(F.col("source")).alias("src"), urls.crawl_key(F.col("url")).alias("dst")).distinct()
    seeds = _t(s, d, "links").where("host = 'lantern-serials.example' and source is not null").select(urls.crawl_key(F.col("source")).alias("url")).distinct().withColumn("depth", F.lit(0))
    return graph.crawl(edges, seeds, 3)


@query("a1_hash_groups", "SELECT raw_sha256, n, story_id FROM (SELECT raw_sha256, story_id, count(*) OVER (PARTITION BY raw_sha256) AS n FROM stories WHERE raw_sha256 <> '') WHERE n > 1")
def _(s, d):
    """The groups by their members, a row each, so no group is one row however many it has."""
    st = _t(s, d, "stories").where("raw_sha256 <> ''").select("raw_sha256", "story_id")
    return st.join(st.groupBy("raw_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "raw_sha256").select("raw_sha256", "n", "story_id")


@query("x5_change_report", f"""WITH c AS (SELECT left(sha256(url), 16) AS id, CASE WHEN source_changed = 1 THEN 'updated' WHEN status = 'failed' THEN 'removed' ELSE 'added' END AS change FROM (SELECT DISTINCT url, source_changed, status FROM stories WHERE url IS NOT NULL)),
    r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY id) AS r FROM c)
    SELECT k.change, (SELECT count(*) FROM c WHERE c.change = k.change) AS n, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM r WHERE r.change = k.change AND r <= {catalog.LISTED}), '') AS ids FROM (VALUES ('added'), ('updated'), ('removed')) k(change)""")
def _(s, d):
    st = _t(s, d, "stories").where("url is not null").select("url", "source_changed", "status").distinct()
    change = F.when(F.col("source_changed") == 1, "updated").when(F.col("status") == "failed", "removed").otherwise("added")
    return catalog.change_report(st.select(F.left(F.sha2("url", 256), F.lit(16)).alias("id"), change.alias("change")))


@query("a12_paragraph_metrics", "SELECT status, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, max(max_paragraph_chars) AS longest, CAST(sum(dialogue_breaks) AS BIGINT) AS breaks, CAST(sum(unsplit_dialogue) AS BIGINT) AS unsplit FROM stories GROUP BY status")
def _(s, d):
    return _t(s, d, "stories").groupBy("status").agg(F.sum("paragraphs").alias("paragraphs"), F.max("max_paragraph_chars").alias("longest"), F.sum("dialogue_breaks").alias("breaks"), F.sum("unsplit_dialogue").alias("unsplit"))


@query("q30_conformed", "SELECT story_id, coalesce(title, '') AS title, coalesce(telugu, 0) AS telugu, part_number, coalesce(error, '') AS error FROM stories")
def _(s, d):
    return schema.conformed(_t(s, d, "stories"), schema.STORIES).select("story_id", "title", "telugu", "part_number", "error")


@query("s17_page_json")
def _(s, d):
    return htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", F.to_json(F.struct("title", "blocks", "links", "images")).alias("document"))


@query("t4_images")
def _(s, d):
    return htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", F.explode("images").alias("src"))


_FIXTURE = """<html><head><title>T</title><base href="https://a.example/d/"></head><body><article><h1>T</h1><p>x <a href="b?q=1">one <b>two</b></a> <a href="#top">top</a>
<a href="/c" rel="nofollow">no</a><a href="mailto:x@a.example">mail</a><a href="https://b.example/">three</a></p><img src="i.png"><img data-src="j.png"><img src="i.png">
<table><tr><th>n</th><th>year</th></tr><tr><td></td><td> </td></tr><tr><td>one <i>and</i></td><td>2020</td></tr></table><ul><li>tea<li>milk</li></ul></article></body></html>"""


def _fixture(s):
    """A literal page, for what the pages of the test tables don't hold."""
    return htmlpage.parsed(s.createDataFrame([(1, "https://a.example/x", _FIXTURE), (2, None, "<p>plain"), (3, "u", None)], "page_id long, url string, html string"))


@query("t3_links_fixture", "SELECT * FROM (VALUES (1, 'https://a.example/d/b?q=1', 'one two'), (1, 'https://b.example/', 'three')) t(page_id, url, text)")
def _(s, d):
    return _fixture(s).select("page_id", F.inline("links"))


@query("t4_images_fixture", "SELECT * FROM (VALUES (1, 'i.png'), (1, 'j.png')) t(page_id, src)")
def _(s, d):
    return _fixture(s).select("page_id", F.explode("images").alias("src"))


@query("t5_tables_fixture", "SELECT * FROM (VALUES (1, 'table', 0, 'n | year'), (1, 'table', 1, 'one and | 2020'), (1, 'list', 0, 'tea'), (1, 'list', 1, 'milk')) t(page_id, kind, pos, content)")
def _(s, d):
    done = _fixture(s)
    rows = done.select("page_id", F.explode("tables").alias("t")).select("page_id", F.lit("table").alias("kind"), F.posexplode("t").alias("pos", "r")).select("page_id", "kind", "pos", F.array_join("r", " | ").alias("content"))
    return rows.unionByName(done.select("page_id", F.explode("lists").alias("t")).select("page_id", F.lit("list").alias("kind"), F.posexplode("t").alias("pos", "content")))


@query("t5_table_rows")
def _(s, d):
    return htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", F.posexplode("tables").alias("table_no", "t")).select("page_id", "table_no", F.posexplode("t").alias("row_no", "cells"))


@query("x2_orphans_fixture", "SELECT * FROM (VALUES ('orphan_raw_file', 'z.html'), ('orphan_formatted_file', 'a.html')) t(kind, file)")
def _(s, d):
    st = s.createDataFrame([("a.html", "", None, "c/a.html")], "raw_file string, formatted_file string, romanized_file string, organized_file string")
    return catalog.orphan_files(st, s.createDataFrame([("raw", "a.html"), ("raw", "z.html"), ("formatted", "a.html"), ("organized", "c/a.html")], "stage string, name string"))


@query("t5_lists_and_tables")
def _(s, d):
    b = htmlpage.parsed(_t(s, d, "raw_pages")).select("page_id", F.explode("blocks").alias("b"))
    return b.where("b.kind in ('list', 'table')").groupBy("page_id", F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("t9_dialogue_turns")
def _(s, d):
    return segment.turns(_t(s, d, "stories"))


@query("p11_page_stems")
def _(s, d):
    return _t(s, d, "stories").where("url is not null").select("story_id", settings.page_stem(F.col("title"), F.col("url")).alias("stem"))


@query("p12_stem_matches", "SELECT story_id, ends_with(raw_file, '-' || left(sha256(url), 12) || '.html') AS by_url FROM stories WHERE url IS NOT NULL AND raw_file <> ''")
def _(s, d):
    return _t(s, d, "stories").where("url is not null and raw_file <> ''").select("story_id", settings.stem_matches(F.col("raw_file"), F.col("url")).alias("by_url"))


@query("p13_decoded", "SELECT page_id, " + _sql_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM raw_pages WHERE html IS NOT NULL")
def _(s, d):
    return _t(s, d, "raw_pages").where("html is not null").select("page_id", X.normal_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query("p18_clamped", "SELECT id, least(greatest(coalesce(CAST(trunc(try_cast(regexp_extract(command, '(\\d+)$', 1) AS DOUBLE)) AS BIGINT), 20), 1), 200) AS batch FROM job_runs")
def _(s, d):
    return _t(s, d, "job_runs").select("id", settings.clamp(F.regexp_extract("command", r"(\d+)$", 1), "auto_batch").alias("batch"))


@query(
    "p8_components",
    r"""WITH a AS (SELECT story_id, regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[<>:"/\\|?*\x{00}-\x{1f}]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS t FROM stories),
    b AS (SELECT story_id, regexp_replace(left(CASE WHEN regexp_matches(t, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || t ELSE t END, 120), '[ .]+$', '') AS t FROM a)
    SELECT story_id, CASE WHEN t = '' THEN 'Untitled Story' ELSE t END AS name FROM b""",
)
def _(s, d):
    return _t(s, d, "stories").select("story_id", T.component(F.col("title"), "Untitled Story").alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_name(k): v for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {_name(k): v for k, v in SQL.items()}


def _name(key: str) -> str:
    """Scalar functions are f1_ to f28_, so no name looks like one of a problem."""
    return "f" + key[1:] if key[0] == "p" and key[1].isdigit() else key
