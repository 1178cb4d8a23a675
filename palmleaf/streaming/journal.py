"""The journal as a stream: the folded state of each url, and the pages of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palmleaf.streaming import versions

SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("state", T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])),
        T.StructField("logged_at", T.TimestampType()),
    ]
)


def stream(spark: SparkSession, path: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """The journal's files in the order of their arrival; the checkpoint of the query holds what was read."""
    reader = spark.readStream.schema(SCHEMA).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def folded(events: DataFrame) -> DataFrame:
    """The same fold as that of the batch, for update or complete mode: late records count by
    their seq, so their order of arrival doesn't matter. One row of state per url."""
    from palmleaf.operators.links import fold_journal

    return fold_journal(events)


def failures_per_hour(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(start, n): failures per hour of their log time; records later than the watermark are left out."""
    df = events.where("logged_at is not null and state.status = 'failed'").withWatermark("logged_at", late)
    return df.groupBy(F.window("logged_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def run_once(folded_stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Run over everything that has arrived and return the result as a table in memory; for tests and small states."""
    q = folded_stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return folded_stream.sparkSession.table(name)


def upsert_into(folded_stream: DataFrame, target: str, checkpoint: str):
    """Keep a table of states up to date: every micro-batch rewrites the parts of the table that its urls are in.

    ``versions.current`` reads the table.
    """

    def change(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch if old is None else old.join(batch.select("url"), "url", "left_anti").unionByName(batch)

    def write(batch: DataFrame, number: int) -> None:
        versions.merge(batch, target, number, "url", change)

    return folded_stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
