"""Folders for what a job writes and reads again, and small files in whatever store a path names."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which driver and executors share; a temporary folder only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return base.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="mathloom-")


def file_system(spark: SparkSession, where: str):
    """(path, file system) of Hadoop for a place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a new folder below the shared one; it goes with `remove`, or when the driver's JVM ends."""
    where = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    path, fs = file_system(spark, where)
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path)
    return where


def remove(spark: SparkSession, where: str) -> None:
    path, fs = file_system(spark, where)
    fs.delete(path, True)


def write_text(spark: SparkSession, where: str, text: str, replace: bool = True) -> None:
    write_bytes(spark, where, text.encode(), replace)


def write_bytes(spark: SparkSession, where: str, data: bytes, replace: bool = True) -> None:
    """A small file, there with all of its bytes or not at all: it is written beside its place and then renamed."""
    path, fs = file_system(spark, where)
    fs.mkdirs(path.getParent())
    part, _ = file_system(spark, f"{path.getParent()}/.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), fs.getConf()).rename(part, path, how)
    except Exception:
        fs.delete(part, False)
        raise


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = file_system(spark, where)
    return fs.exists(path)


def read_bytes(spark: SparkSession, where: str) -> bytes:
    """A small file's bytes."""
    return bytes(spark.read.format("binaryFile").load(where).select("content").first()[0])


def read_text(spark: SparkSession, where: str) -> str:
    """A small file's text."""
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(where).collect())
