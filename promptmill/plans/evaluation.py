"""The whole evaluation of recorded completions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions.scores import parse_k, samples_needed
from promptmill.operators.completions import TASK, clean_completions, pair_candidates
from promptmill.operators.report import metrics_report, result_record
from promptmill.sinks.scratch import scratch_table
from promptmill.sinks.tables import save_result


def evaluate(
    completions: DataFrame,
    tasks: DataFrame,
    verdicts: DataFrame,
    pass_k: str | Sequence[int] | None = None,
    benchmark: str = "all",
) -> DataFrame:
    """Clean the completions, pair them with their tasks, report the metrics per benchmark."""
    candidates = pair_candidates(clean_completions(completions), tasks, every_task=True)
    return metrics_report(candidates, verdicts, pass_k, benchmark)


def evaluate_and_save(
    completions: DataFrame,
    tasks: DataFrame,
    verdicts: DataFrame,
    output: str,
    model: str,
    pass_k: str | Sequence[int] | None = None,
    benchmark: str = "all",
    temperature: float = 0.0,
    top_p: float = 0.95,
    max_new_tokens: int = 2048,
) -> DataFrame:
    """The report, computed once, stored, and appended to the result table at ``output``."""
    wanted = samples_needed(pass_k)
    fewest = verdicts.groupBy(*TASK).count().agg(F.min("count")).first()[0]
    if fewest is not None and fewest < wanted:
        raise ValueError(f"pass@{wanted} needs {wanted} samples of every task; one has {fewest}.")
    report = scratch_table(evaluate(completions, tasks, verdicts, pass_k, benchmark))
    settings = {
        "benchmark": benchmark,
        "temperature": temperature,
        "top_p": top_p,
        "max_new_tokens": max_new_tokens,
    }
    save_result(result_record(report, model, parse_k(pass_k), settings), output)
    return report
