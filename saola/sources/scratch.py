"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set a local session gets a folder of its own; on a
    cluster that is an error, because executors don't see one another's disks."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = _own.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="saola-")
        _own[spark.sparkContext.applicationId] = given
    return given.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, path: str) -> None:
    """Has an existing path deleted when the session's JVM ends."""
    target, files = _path(spark, path)
    files.deleteOnExit(target)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
    path = f"{root}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table goes when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    forget(spark, root)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = root
    return back


def unstage(df: DataFrame) -> None:
    """Deletes the table of a staged df that no plan needs any more."""
    if root := getattr(df, "_staged", None):
        target, files = _path(df.sparkSession, root)
        files.delete(target, True)
