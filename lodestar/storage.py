"""The folder that all executors share, and tables settled in it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SEEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, but only in local mode: on a cluster no folder of one machine will do."""
    name = "spark.checkpoint.dir"
    have = spark.conf.get(name, None)
    if have:
        return have.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{name} must name a folder that all executors share")
    have = os.path.join(tempfile.gettempdir(), "lodestar-shared")
    spark.conf.set(name, have)
    return have


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path that nothing has yet, in this application's part of the shared folder, which is deleted at the end."""
    root = f"{shared_folder(spark)}/lodestar/{spark.conf.get('spark.app.id', 'app')}"
    if not _SEEN:
        atexit.register(clean)
    _SEEN.add(root)
    return f"{root}/{kind}-{uuid.uuid4().hex}"


#: Whether Spark deletes the files of a query's exchanges when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors lose nothing, and what is used twice is made once.

    The exchanges of df are deleted with it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    usual = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, usual)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, nothing if there is none."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    rows = spark.read.text(path, wholetext=True).collect()  # one row, none of an empty file
    return rows[0][0] if rows else ""


def write_new(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file that is not there yet; False if it is, whoever made it."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Exception:
        if fs.exists(at):
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def move(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or a folder to a place that does not exist yet."""
    fs, at = _at(spark, path)
    there = _at(spark, to)[1]
    fs.mkdirs(there.getParent())
    if not fs.rename(at, there):
        raise OSError(f"{path} could not be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all it holds."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a settled table, which nothing may read any longer."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def clean() -> None:
    """Deletes what this application has settled. Frames that read it can be read no longer."""
    spark = SparkSession.getActiveSession()
    for root in list(_SEEN) if spark is not None else ():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _SEEN.discard(root)
        except Exception:  # noqa: BLE001 - the session may have ended
            return
