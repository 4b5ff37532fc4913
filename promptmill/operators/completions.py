"""From recorded model output to candidates paired with their tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions import code as C
from promptmill.operators.joins import lookup_join

TASK = ("benchmark", "task_id")
SAMPLE = ("benchmark", "task_id", "sample_idx")


def clean_completions(completions: DataFrame) -> DataFrame:
    """The completion text cut down to its code."""
    return completions.withColumn("text", C.clean_completion("text"))


def pair_candidates(completions: DataFrame, tasks: DataFrame, every_task: bool = False) -> DataFrame:
    """Each sample with its task's reference and test; HumanEval samples as whole programs.

    With ``every_task``, a task nobody answered gets an empty sample 0, so that it counts as a
    failure instead of leaving the metrics. ``pairing_counts`` tells what has no partner.
    """
    joined = lookup_join(completions, tasks, TASK, SAMPLE)
    if every_task:
        silent = tasks.join(completions.select(*TASK).distinct(), [*TASK], "left_anti")
        blank = silent.withColumns({"sample_idx": F.lit(0), "text": F.lit("")})
        joined = joined.select(*blank.columns).unionByName(blank)
    candidate = F.when(
        F.col("benchmark") == "humaneval", C.humaneval_candidate("prompt", "text")
    ).otherwise(F.col("text"))
    return joined.select(*SAMPLE, candidate.alias("candidate"), "reference", "test")


def pairing_counts(completions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per benchmark: tasks, samples, tasks without any sample, samples without a task.

    Reads keys only; samples are counted per task before they meet the tasks.
    """
    answered = completions.groupBy(*TASK).agg(F.count(F.lit(1)).alias("_samples"))
    known = tasks.groupBy(*TASK).agg(F.count(F.lit(1)).alias("_tasks"))
    return (
        known.join(answered, [*TASK], "full")
        .groupBy("benchmark")
        .agg(
            F.coalesce(F.sum("_tasks"), F.lit(0)).alias("tasks"),
            F.coalesce(F.sum("_samples"), F.lit(0)).alias("samples"),
            F.count_if(F.col("_samples").isNull()).alias("silent_tasks"),
            F.coalesce(F.sum(F.when(F.col("_tasks").isNull(), F.col("_samples"))), F.lit(0)).alias("stray_samples"),
        )
    )


def first_candidates(rows: DataFrame) -> DataFrame:
    """The sample with the lowest number of each task, whatever that number is."""
    order = Window.partitionBy(*TASK).orderBy("sample_idx", F.xxhash64("candidate"))
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def choose_benchmark(rows: DataFrame, choice: str = "all") -> DataFrame:
    if choice not in ("all", "humaneval", "mbpp"):
        raise ValueError(f"{choice!r} is no benchmark; choose all, humaneval or mbpp.")
    return rows if choice == "all" else rows.filter(F.col("benchmark") == choice)
