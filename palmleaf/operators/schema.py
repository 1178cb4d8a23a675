"""Explicit schemas, and tables of older versions brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


LINKS = _struct("link_id:l url:s normalized_url:s title:s source:s host:s status:s error:s retry_count:i next_retry_at:s discovered_at:s updated_at:s")
JOB_RUNS = _struct("id:l name:s command:s state:s started_at:s finished_at:s exit_code:i error:s")
STORIES = _struct(
    "story_id:l url:s title:s source_host:s words:i raw_file:s formatted_file:s romanized_file:s status:s integrity_exact:i telugu:i romanized:i paragraphs:i dialogue_breaks:i"
    " dialogue_turns:i unsplit_dialogue:i max_paragraph_chars:i quality_pass:i formatter_version:i review_reason:s error:s raw_sha256:s original_text:s formatted_text:s romanized_text:s"
    " updated_at:s manual_accept:i series_title:s part_number:i category:s category_source:s category_locked:i organized_file:s added_at:s source_changed:i previous_raw_sha256:s"
)
#: Columns in which NULL means something; all other missing texts are '', missing numbers 0.
NULLABLE = frozenset({"part_number", "exit_code"})


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are added with their default, others
    are dropped, types are cast. Applying it twice changes nothing."""
    out = []
    for f in schema.fields:
        default = F.lit(None) if f.name in NULLABLE else F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0)
        given = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append(F.coalesce(given, default.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def merged(*tables: DataFrame, schema: T.StructType) -> DataFrame:
    """Tables of any versions as one."""
    out = None
    for t in tables:
        t = conformed(t, schema)
        out = t if out is None else out.unionByName(t)
    return out
