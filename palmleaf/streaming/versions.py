"""Tables that micro-batches keep up to date, in parts by the hash of their key.

A version holds only the parts that its batch touched: ``target/v=N/part=K``. The newest version of each part is
the table. A batch that runs again writes the same version again, from the same older ones. An older part that can't be read
fails the batch; only a part without any version counts as empty. The folder must be shared by all executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def _fs(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """{part: {version: path}} of the folders below a target; names only, no file is opened."""
    fs, path = _fs(spark, target)
    found: dict[int, dict[int, str]] = {}
    for v in fs.listStatus(path) if fs.exists(path) else []:
        name = v.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            for p in fs.listStatus(v.getPath()):
                if p.getPath().getName().startswith("part="):
                    found.setdefault(int(p.getPath().getName()[5:]), {})[int(name[2:])] = p.getPath().toString()
    return found


def current(spark: SparkSession, target: str, below: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The table as of the versions under ``below``, or some of its parts; None if there is none yet."""
    paths = []
    for part, versions in sorted(_listed(spark, target).items()):
        old = [v for v in versions if below is None or v < below]
        if old and (parts is None or part in parts):
            paths.append(versions[max(old)])
    # a part whose last rows went is an empty folder
    paths = [p for p in paths if _fs(spark, p)[0].listStatus(_fs(spark, p)[1])]
    return spark.read.option("basePath", target).parquet(*paths).drop("v", "part") if paths else None


def merge(batch: DataFrame, target: str, number: int, key: str, change) -> None:
    """Write version ``number``: ``change(old, batch)`` on the parts that the batch touches; old is None where nothing was before."""
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    touched = sorted(r[0] for r in batch.select(part.alias("p")).distinct().collect())  # at most PARTS numbers
    if touched:
        new = change(current(spark, target, number, touched), batch)
        new.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={number}")
        for p in touched:
            fs, path = _fs(spark, f"{target}/v={number}/part={p}")
            fs.mkdirs(path)
