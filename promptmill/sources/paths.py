"""File-system questions asked through Hadoop, so any store Spark reads works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def exists(spark: SparkSession, path: str) -> bool:
    """True for an existing file or folder, or a glob that matches something."""
    fs, handle = _locate(spark, path)
    return bool(fs.globStatus(handle))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, handle = _locate(spark, path)
    return bool(fs.getFileStatus(handle).isDirectory())


def children(spark: SparkSession, path: str) -> list[str]:
    fs, handle = _locate(spark, path)
    return [status.getPath().toString() for status in fs.listStatus(handle)]


def make_folder(spark: SparkSession, path: str) -> None:
    fs, handle = _locate(spark, path)
    fs.mkdirs(handle)


def remove(spark: SparkSession, path: str) -> None:
    fs, handle = _locate(spark, path)
    fs.delete(handle, True)


def signature(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Names, lengths and times of the files at ``path``, sorted."""
    fs, handle = _locate(spark, path)
    pending, found = list(fs.globStatus(handle) or []), []
    while pending:
        status = pending.pop()
        if status.isDirectory():
            pending.extend(fs.listStatus(status.getPath()))
        else:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)
