"""Benchmark tasks, recorded completions and recorded verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.functions import code as C
from promptmill.sources.datasets import read_dataset

HUMANEVAL_FIELDS = ("prompt", "canonical_solution", "test", "entry_point")
COMPLETIONS_SCHEMA = "benchmark STRING, task_id STRING, sample_idx INT, text STRING"
VERDICTS_SCHEMA = "benchmark STRING, task_id STRING, sample_idx INT, passed BOOLEAN"

# One row per task, whatever the benchmark.
TASK_FIELDS = ("benchmark", "task_id", "prompt", "reference", "test")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A local copy of a benchmark or a recorded table, Parquet or JSON by extension.

    JSON is read as data sets are: arrays or lines, file by file; a broken record fails the read.
    """
    bare = path.rstrip("/").removesuffix(".gz")
    is_json = bare.endswith((".json", ".jsonl"))
    if is_json:
        return read_dataset(spark, path, None if schema is None else T.StructType.fromDDL(schema))
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def _optional(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def humaneval_tasks(rows: DataFrame) -> DataFrame:
    """HumanEval rows as tasks: stripped prompt, reference text, test program."""
    return rows.select(
        F.lit("humaneval").alias("benchmark"),
        F.col("task_id").cast("string").alias("task_id"),
        C.strip("prompt").alias("prompt"),
        C.humaneval_reference("prompt", "canonical_solution").alias("reference"),
        C.humaneval_test("test", "entry_point").alias("test"),
    )


def mbpp_tasks(rows: DataFrame) -> DataFrame:
    """MBPP rows as tasks. Either of ``prompt`` and ``text`` may be absent."""
    code = F.coalesce(_optional(rows, "code", "string"), F.lit(""))
    return rows.select(
        F.lit("mbpp").alias("benchmark"),
        F.col("task_id").cast("string").alias("task_id"),
        C.mbpp_prompt(_optional(rows, "prompt", "string"), _optional(rows, "text", "string"), code).alias(
            "prompt"
        ),
        code.alias("reference"),
        C.mbpp_test(
            _optional(rows, "test_setup_code", "string"),
            _optional(rows, "test_imports", "array<string>"),
            _optional(rows, "test_list", "array<string>"),
        ).alias("test"),
    )


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, COMPLETIONS_SCHEMA)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, VERDICTS_SCHEMA)
