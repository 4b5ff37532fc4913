"""Syntax rate and pass@k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions.pyparse import is_valid_python
from promptmill.functions.scores import pass_at_k


def syntax_rate(first: DataFrame, by: Sequence[str] = (), code: str = "candidate") -> DataFrame:
    """Share of texts that parse as Python; 0.0 for no texts."""
    share = F.avg(is_valid_python(code).cast("double"))
    return first.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("syntax_rate"))


def task_pass_counts(verdicts: DataFrame, task: Sequence[str] = ("benchmark", "task_id")) -> DataFrame:
    """Samples and passed samples per task, combined before the shuffle."""
    return verdicts.groupBy(*task).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("passed")).alias("c")
    )


def mean_pass_at_k(counts: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per ``k``: the mean over tasks, or 0.0 where some task has fewer samples.

    All values of ``k`` come from one pass over the per-task counts.
    """
    wide = counts.groupBy(*by).agg(
        F.min("n").alias("_fewest"), *[F.avg(pass_at_k("n", "c", k)).alias(f"_k{k}") for k in ks]
    )
    scores = F.array(
        *[
            F.struct(
                F.lit(k).cast("bigint").alias("k"),
                F.when(F.col("_fewest") >= k, F.col(f"_k{k}")).otherwise(F.lit(0.0)).alias("pass_at_k"),
            )
            for k in ks
        ]
    )
    return wide.select(*by, F.inline(scores))


def pass_map(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """The scores of one group as a map from "pass@k", smallest k first."""
    entries = F.array_sort(F.collect_list(F.struct("k", "pass_at_k")))
    pairs = F.transform(
        entries, lambda e: F.struct(F.concat(F.lit("pass@"), e["k"].cast("string")), e["pass_at_k"])
    )
    return scores.groupBy(*by).agg(F.map_from_entries(pairs).alias("pass_at_k"))
