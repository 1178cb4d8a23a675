"""Queries of the problems 1 to 9; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.llm import boilerplate, language, leaks, linklog, lines, neardup, packing, quality, residue
from palmleaf.session import stage, table


def _tracking(spark: SparkSession, d: str) -> list[str]:
    """The project's tracking fields: a short list of settings."""
    return sorted(r[0].lower() for r in _settings(table(spark, d, "tracking_keys").select("key_name").where("key_name is not null")))


def _settings(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a table of settings; one of more than ``most`` rows is none and raises."""
    rows = df.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings has at most {most} rows")
    return rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stories = table(spark, d, "stories")
    found = boilerplate.boilerplate(stories, table(spark, d, "raw_pages"))
    return found.join(residue.residue(stories), "story_id", "left_anti")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "stories"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    stories = table(spark, d, "stories")
    contents = language.fit(table(spark, d, "documents"), stories)
    return language.languages(stories.select("story_id", "telugu", "original_text"), contents).join(residue.residue(stories), "story_id", "left_anti")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabel(stage(_languages(spark, d), "languages")).select("story_id", "line_no", "lang")


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("line_no = 0").select("story_id", "lang", "confidence", "rejected")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(table(spark, d, "stories").select("story_id", "url", "raw_sha256", "original_text"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "stories").select("story_id", "url", "raw_sha256", "original_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linklog.copies(table(spark, d, "links"), _tracking(spark, d))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return linklog.pages(table(spark, d, "links"), _tracking(spark, d)).select("first_id", "n")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "stories"))


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    found, _ = lines.prefixspan(table(spark, d, "stories"))
    return found.groupBy(F.size("pattern").cast("long").alias("n_lines"), "support").agg(F.count(F.lit(1)).alias("n_patterns"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated(table(spark, d, "stories"))


def _packs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = table(spark, d, "pack_sizes").where("pack_name is not null and capacity_tokens > 0").distinct()
    listed = sorted((r[0], r[1]) for r in _settings(sizes.select("pack_name", "capacity_tokens")))
    return packing.pack(packing.token_counts(table(spark, d, "documents")), listed), sizes


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(*_packs(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_documents(p8_found(spark, d))


def p8_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), tolerant_share=0.8)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.round(c, 6).alias(c) for c in ("list_share", "table_share", "junk_share")]
    return quality.shares(table(spark, d, "documents")).select("doc_id", *cols)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.failures(quality.statistics(table(spark, d, "documents")))


_BARE = "regexp_replace(url, '^\\s+|\\s+$', '', 'g')"


def _piece(i: int) -> str:
    return f"regexp_extract({_BARE}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)\\??([^#]*)(?:#.*)?$', {i})"


def _plain(c: str) -> str:
    return f"url_decode(replace({c}, '+', ' '))"


_PAGE = f"""SELECT link_id, lower({_piece(1)}) AS s, CASE WHEN lower({_piece(1)}) = 'https' THEN regexp_replace(lower({_piece(2)}), ':443$', '') ELSE lower({_piece(2)}) END AS h,
    regexp_replace({_plain(_piece(3))}, '/+$', '') AS p,
    list_sort(list_filter(list_transform(list_filter(string_split({_piece(4)}, '&'), lambda f: f <> ''),
      lambda f: {{'n': {_plain("split_part(f, '=', 1)")}, 'v': {_plain("substr(f, length(split_part(f, '=', 1)) + 2)")}}}),
      lambda x: NOT list_contains(tk, lower(x.n)))) AS q FROM links, (SELECT list(lower(key_name)) AS tk FROM tracking_keys) WHERE {_BARE} <> ''"""

_LINES = """SELECT story_id, source_host, url, row_number() OVER (PARTITION BY story_id ORDER BY i) AS line_no, trim(regexp_replace(lower(x), '[^\\p{L}\\p{M}]+', ' ', 'g')) AS k
    FROM (SELECT story_id, source_host, url, unnest(string_split(original_text, chr(10))) AS x, generate_subscripts(string_split(original_text, chr(10)), 1) AS i FROM stories WHERE source_host <> '' AND url IS NOT NULL AND original_text IS NOT NULL) WHERE regexp_matches(x, '\\S')"""


def _words(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({c}), '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')), lambda x: x <> '')"


_NEAR = f"""WITH w AS (SELECT story_id, url, raw_sha256, {_words('original_text')} AS w FROM stories WHERE original_text IS NOT NULL),
    g AS (SELECT DISTINCT story_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT story_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 50)),
    n AS (SELECT story_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT a.story_id AS a, b.story_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.story_id < b.story_id GROUP BY 1, 2)
    SELECT c.a AS story_id_a, c.b AS story_id_b FROM c JOIN n x ON x.story_id = c.a JOIN n y ON y.story_id = c.b JOIN w p ON p.story_id = c.a JOIN w q ON q.story_id = c.b
    WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= 0.6 AND (p.url IS NULL OR q.url IS NULL OR p.url <> q.url) AND coalesce(nullif(p.raw_sha256, '') <> nullif(q.raw_sha256, ''), true)"""

_LEAKS = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_words('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
    k AS (SELECT item_id, w, least(12, len(w)) AS k FROM e WHERE len(w) > 0), ks AS (SELECT DISTINCT k FROM k),
    p AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
    t AS (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks))
    SELECT DISTINCT doc_id, item_id FROM t JOIN p USING (k, g)"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(CAST({part} AS DOUBLE) / {whole}, 6) ELSE 0.0 END"


def _hits(arr: str, pattern: str) -> str:
    return f"len(list_filter({arr}, lambda y: regexp_matches(y, '{pattern}')))"


_STATS = f"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda y: y <> '') AS w,
      list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^ \\t\\r]')) AS l FROM documents),
    s AS (SELECT doc_id, len(w) AS n_words, {_share("length(array_to_string(w, ''))", "len(w)")} AS mean_word_length,
      {_share("length(text) - length(regexp_replace(text, '[#…{}<>|\\\\^~=+*_$%@&]', '', 'g'))", "len(w)")} AS symbol_ratio,
      {_share(_hits("l", "[.!?…।\"”’''\\)]\\s*$"), "len(l)")} AS end_punctuation_share,
      {_share(_hits("l", "^\\s*[-*•‣·–]\\s"), "len(l)")} AS bullet_share,
      {_share(_hits("l", "(\\.\\.\\.|…)\\s*$"), "len(l)")} AS ellipsis_share,
      {_share(_hits("w", "\\p{L}"), "len(w)")} AS alpha_word_share,
      {_share("len(list_filter(w, lambda y: regexp_replace(y, '[^a-z]', '', 'g') IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with')))", "len(w)")} AS common_word_share FROM t WHERE text IS NOT NULL)
    SELECT *, concat_ws(',', CASE WHEN n_words < 50 THEN 'too_few_words' END, CASE WHEN n_words > 100000 THEN 'too_many_words' END,
      CASE WHEN mean_word_length < 3 OR mean_word_length > 10 THEN 'word_length' END, CASE WHEN symbol_ratio > 0.1 THEN 'symbols' END, CASE WHEN bullet_share > 0.9 THEN 'bullets' END,
      CASE WHEN ellipsis_share > 0.3 THEN 'ellipses' END, CASE WHEN end_punctuation_share < 0.1 THEN 'no_end_punctuation' END, CASE WHEN alpha_word_share < 0.8 THEN 'few_letters' END) AS reasons FROM s"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _NEAR,
        "p8_found": _LEAKS,
        "p8_documents": f"SELECT doc_id, count(*) AS n_items, array_to_string(list_transform(list_sort(list(item_id)), lambda x: CAST(x AS VARCHAR)), ',') AS items FROM ({_LEAKS}) GROUP BY doc_id",
        "p5_found": f"WITH c AS ({_PAGE}), f AS (SELECT *, min(link_id) OVER (PARTITION BY s, h, p, q) AS f FROM c) SELECT f AS link_id_first, link_id AS link_id_copy FROM f WHERE f <> link_id",
        "p5_pages": f"SELECT min(link_id) AS first_id, count(*) AS n FROM ({_PAGE}) GROUP BY s, h, p, q",
        "p6_found": f"WITH l AS ({_LINES}), k AS (SELECT * FROM l WHERE length(replace(k, ' ', '')) >= 12), f AS (SELECT source_host, k FROM k GROUP BY 1, 2 HAVING count(DISTINCT url) >= 5) SELECT story_id, line_no FROM k JOIN f USING (source_host, k)",
        "p6_clean": f"""WITH l AS ({_LINES}), k AS (SELECT * FROM l WHERE length(replace(k, ' ', '')) >= 12), f AS (SELECT source_host, k FROM k GROUP BY 1, 2 HAVING count(DISTINCT url) >= 5), r AS (SELECT DISTINCT story_id, line_no FROM k JOIN f USING (source_host, k)),
            a AS (SELECT story_id, unnest(string_split(original_text, chr(10))) AS x, generate_subscripts(string_split(original_text, chr(10)), 1) AS i FROM stories WHERE original_text IS NOT NULL),
            b AS (SELECT *, CASE WHEN regexp_matches(x, '\\S') THEN count(*) FILTER (regexp_matches(x, '\\S')) OVER (PARTITION BY story_id ORDER BY i) END AS line_no FROM a),
            c AS (SELECT b.story_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (r.line_no IS NULL), '') AS clean_text, count(r.line_no) AS n_removed FROM b LEFT JOIN r ON r.story_id = b.story_id AND r.line_no = b.line_no GROUP BY 1)
            SELECT s.story_id, c.clean_text, coalesce(c.n_removed, 0) AS n_removed FROM stories s LEFT JOIN c USING (story_id)""",
        "p9_statistics": _STATS,
    }
