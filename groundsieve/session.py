"""Session defaults and lineage handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "groundsieve", master: str | None = None, partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster, pass nothing: spark-submit decides."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    return b.getOrCreate()


def local_folder(spark: SparkSession) -> str:
    """A new temporary folder, on a local master only."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder path under ``spark.checkpoint.dir``; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``. Without one, a local master gets a
    temporary folder; a cluster is refused, since its executors do not share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if shared and not current:
        sc.setCheckpointDir(shared)
    elif not current:
        sc.setCheckpointDir(local_folder(spark))
    return df.checkpoint(eager=True)
