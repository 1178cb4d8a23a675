"""Session settings and staged tables shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "palmleaf") -> SparkSession:
    """A local session with the settings that the engine expects from a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_dir(spark: SparkSession) -> str:
    """The folder for staged tables: spark.checkpoint.dir of the session.

    Only a local master without that setting gets a temporary folder; on a
    cluster a folder that not every executor sees would lose data.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_palmleaf_stage", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palmleaf-")
        sc._palmleaf_stage = found
        sc.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage,
    survives the loss of executors, and lets several plans reuse the rows.

    The optimizer measures a staged table by its compressed files when it decides on a broadcast, so the threshold
    (``spark.sql.autoBroadcastJoinThreshold``) bounds these; ``spark.sql.sources.fileCompressionFactor`` of the session tightens it.
    ``release`` drops the tables.
    """
    spark = df.sparkSession
    folder = f"{stage_dir(spark)}/palmleaf-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    staged = spark.sparkContext.__dict__.setdefault("_palmleaf_staged", [])
    if not staged:
        atexit.register(release, spark)
    staged.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session. Results that still read them must be consumed or written before."""
    staged = spark.sparkContext.__dict__.get("_palmleaf_staged", [])
    while staged:
        folder = staged.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except (Py4JError, ConnectionError, AttributeError):
            return  # the session is gone; the cluster cleans its folder


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where the input stands in few parts and the work on each row is long.

    It is for scans: a file of one row group is one part, whatever it holds. Inputs with at least half as many parts as there are
    cores stay as they are, so an input larger than the cluster is never shuffled. Rows and results are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, so that they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_palmleaf_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="palmleaf-")) / "palmleaf.zip"  # on the driver; Spark serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._palmleaf_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
