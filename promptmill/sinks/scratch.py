"""Intermediate tables on storage every executor can reach."""

from __future__ import annotations

import atexit
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from promptmill.sources import paths

SCRATCH_CONF = "spark.checkpoint.dir"
# Used where no folder is named and driver and executors are one process.
LOCAL_FOLDER = "/tmp/checkpoints"

_written: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names; a fixed local one only for single-process sessions."""
    root = spark.conf.get(SCRATCH_CONF, None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_FOLDER
    raise ValueError(f"Set {SCRATCH_CONF} to a folder shared by all executors.")


def new_path(spark: SparkSession) -> str:
    """An unused folder below the scratch root, removed with the session at the latest."""
    path = f"{scratch_root(spark)}/promptmill/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def scratch_table(rows: DataFrame, rows_per_file: int = 0, partition_by: str | None = None) -> DataFrame:
    """Write the rows once and read them back.

    This cuts the lineage, survives lost executors, and unlike a cached plan lets later
    passes read single columns. ``rows_per_file`` splits what one task writes.
    """
    return stored_table(rows, rows_per_file, partition_by)[0]


def stored_table(rows: DataFrame, rows_per_file: int = 0, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """``scratch_table`` and its folder, for callers that ``release`` it early."""
    spark = rows.sparkSession
    path = new_path(spark)
    writer = rows.write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def release(path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    spark = _written.pop(path, None)
    if spark is not None:
        paths.remove(spark, path)


def forget_finished(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark drops what finished passes left.

    Shuffles, broadcasts and compiled plans of many short passes pile up in the driver until then.
    """
    spark.sparkContext._jvm.System.gc()


@atexit.register
def release_all() -> None:
    """Remove every scratch folder of this process whose session still runs."""
    for path, spark in list(_written.items()):
        del _written[path]
        try:
            if spark.sparkContext._jsc is not None:
                paths.remove(spark, path)
        except (AttributeError, OSError, PySparkException):
            pass
