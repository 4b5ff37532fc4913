"""The whole evaluation report and its one-row-per-run record."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.functions.scores import parse_k, run_stamp, safe_model_name, summary_line
from promptmill.operators.codebleu import code_bleu
from promptmill.operators.completions import SAMPLE, choose_benchmark, first_candidates
from promptmill.operators.metrics import mean_pass_at_k, pass_map, task_pass_counts

DISPLAY_NAMES = {"humaneval": "HumanEval", "mbpp": "MBPP"}


def metrics_report(
    candidates: DataFrame,
    verdicts: DataFrame,
    pass_k: str | Sequence[int] | None = None,
    benchmark: str = "all",
) -> DataFrame:
    """``benchmark, syntax_rate, pass_at_k, codebleu``: the three metrics per benchmark.

    ``candidates`` are paired samples, ``verdicts`` the recorded outcomes of their tests. Syntax
    rate and CodeBLEU come from one pass over the first candidates, each parsed once. A
    benchmark without verdicts, or without candidates, has null where nothing was computed.
    """
    by = ["benchmark"]
    first = first_candidates(choose_benchmark(candidates, benchmark))
    scores = mean_pass_at_k(task_pass_counts(choose_benchmark(verdicts, benchmark)), parse_k(pass_k), by)
    report = code_bleu(first, SAMPLE, by).join(pass_map(scores, by), by, "full")
    return report.select("benchmark", "syntax_rate", "pass_at_k", "codebleu")


def summaries(report: DataFrame) -> DataFrame:
    """A line of text per benchmark."""
    names = F.create_map(*[F.lit(x) for item in DISPLAY_NAMES.items() for x in item])
    shown = F.coalesce(F.try_element_at(names, F.col("benchmark")), F.col("benchmark"))
    return report.select(
        "benchmark", summary_line(shown, F.col("syntax_rate"), F.col("pass_at_k"), F.col("codebleu")).alias("line")
    )


def result_record(report: DataFrame, model: str, pass_k: Sequence[int], settings: dict[str, Any]) -> DataFrame:
    """One row for a run: model, settings and the metrics of each benchmark as a map."""
    metrics = F.map_from_entries(
        F.collect_list(F.struct("benchmark", F.struct("syntax_rate", "pass_at_k", "codebleu")))
    )
    return report.agg(metrics.alias("metrics")).select(
        F.lit(model).alias("model"),
        *[F.lit(value).alias(name) for name, value in settings.items()],
        F.array(*[F.lit(k) for k in pass_k]).alias("pass_k"),
        F.current_timestamp().alias("generated_at"),
        "metrics",
        safe_model_name(F.lit(model)).alias("model_safe"),
        run_stamp().alias("run_stamp"),
    )
