"""The folder that all executors share, for tables between steps, and what an input is at a time."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

#: Used on a local master whose session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/lexstrata"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local master has a default, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FOLDER
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def signature(spark: SparkSession, path: str) -> str:
    """The names, sizes and times of the files at a path, as one digest: another one where the input has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    said = []
    while files.hasNext():
        f = files.next()
        said.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine's own tables, on whichever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
