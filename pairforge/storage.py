"""Tables written to the shared folder to cut lineage, so that a lost executor never forces an iterative plan to restart."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Spark's setting for deleting the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where every executor is this process, may the setting be absent: then a temporary folder is made,
    once per process.  On a cluster that is an error, since a machine's own folder is no place for shared tables.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pairforge-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = _own[0]
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema.  ``release`` deletes it; what is left is
    deleted when the application ends.  The shuffle files of the write go with its end, not when the driver's garbage happens to be
    collected: nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairforge-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairforge_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_pairforge_path", None)
        if path:
            files, target = _file_system(df.sparkSession, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)
