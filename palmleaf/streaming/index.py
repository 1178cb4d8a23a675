"""The full-text index kept up to date by a stream, and results published at most so often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.operators.library import postings
from palmleaf.streaming import versions


def changed_postings(old: DataFrame | None, changed: DataFrame) -> DataFrame:
    """The index after some stories changed: their postings are replaced, all others stay.

    Of several versions of a story the last one (by updated_at) counts; a story with ``deleted`` set goes.
    """
    last = changed.groupBy("story_id").agg(F.max_by(F.struct("title", "url", "original_text", "romanized_text", "deleted"), F.coalesce("updated_at", F.lit(""))).alias("s")).select("story_id", "s.*")
    new = postings(last.where("not coalesce(deleted, false)"))
    if old is None:
        return new
    return old.join(last.select("story_id"), "story_id", "left_anti").unionByName(new)


def index_into(changes: DataFrame, target: str, checkpoint: str, every: str | None = None):
    """Rewrite the parts of the index that hold changed stories, for every micro-batch; ``every`` such as
    '4 seconds' debounces, without it the query runs over what has arrived and ends. ``versions.current`` reads the index."""

    def write(batch: DataFrame, number: int) -> None:
        versions.merge(batch, target, number, "story_id", changed_postings)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
