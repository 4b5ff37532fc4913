"""The evaluation report as a stored state that each new batch of completions and verdicts updates.

The state holds what the report is summed from, at the finest grain a replacement needs:
the latest verdict of each sample, the (n, c) counts of each task, the first candidate of each
task, and the clipped n-gram and structure counts of each first pair. A batch replaces the rows
of the samples it names (same benchmark, task and sample number) and adds the others; only
tasks it touches are counted again, and only pairs whose first candidate changed are parsed and
counted again. Each merge is published as a new version (version folders and a pointer written
last), so a merge stopped half-way leaves the last state readable.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.scores import parse_k
from promptmill.operators.codebleu import code_bleu_of, pair_ngrams, pair_structure
from promptmill.operators.completions import SAMPLE, first_candidates
from promptmill.operators.metrics import mean_pass_at_k, pass_map, task_pass_counts
from promptmill.sources import paths

TASK = list(SAMPLE[:2])
PARTS = ("verdicts", "counts", "first", "ngrams", "shapes")
_VERSIONS, _POINTERS = "_versions", "_pointers"


def _current(spark: SparkSession, root: str) -> str | None:
    pointers = f"{root}/{_POINTERS}"
    if not paths.exists(spark, pointers):
        return None
    for pointer in sorted(paths.children(spark, pointers), reverse=True):
        if paths.exists(spark, f"{pointer}/_SUCCESS"):
            return spark.read.json(pointer).first()["version"]
    return None


def read_state(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    version = _current(spark, root.rstrip("/"))
    return None if version is None else {part: spark.read.parquet(f"{version}/{part}") for part in PARTS}


def merge_batch(spark: SparkSession, root: str, candidates: DataFrame, verdicts: DataFrame) -> None:
    """Merge a batch of paired candidates (``SAMPLE``, candidate, reference, ...) and verdicts into the state."""
    root = root.rstrip("/")
    old = read_state(spark, root)
    new_verdicts = verdicts.select(*SAMPLE, "passed")
    touched = new_verdicts.select(*TASK).distinct()
    if old is None:
        merged_verdicts = new_verdicts
        counts = task_pass_counts(merged_verdicts)
    else:
        merged_verdicts = old["verdicts"].join(new_verdicts.select(*SAMPLE), list(SAMPLE), "left_anti").unionByName(new_verdicts)
        recounted = task_pass_counts(merged_verdicts.join(touched, TASK, "left_semi"))
        counts = old["counts"].join(touched, TASK, "left_anti").unionByName(recounted)
    columns = [*SAMPLE, "candidate", "reference"]
    batch = candidates.select(*columns)
    if old is None:
        first = first_candidates(batch)
        changed = first
    else:
        # The first of a task is its smallest sample number; a batch adds or replaces samples, so
        # the old first (unless replaced) and the batch's rows of the task decide it.
        kept = old["first"].join(batch.select(*SAMPLE), list(SAMPLE), "left_anti")
        first = first_candidates(kept.unionByName(batch))
        changed = first.join(old["first"], columns, "left_anti")
    grams, shapes = pair_ngrams(changed, list(SAMPLE)), pair_structure(changed, list(SAMPLE))
    if old is not None:
        gone = changed.select(*TASK).distinct()
        grams = old["ngrams"].join(gone, TASK, "left_anti").unionByName(grams)
        shapes = old["shapes"].join(gone, TASK, "left_anti").unionByName(shapes)
    stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    version = f"{root}/{_VERSIONS}/{stamp}"
    for part, frame in zip(PARTS, (merged_verdicts, counts, first, grams, shapes)):
        frame.write.parquet(f"{version}/{part}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{root}/{_POINTERS}/{stamp}")


def report_from_state(spark: SparkSession, root: str, pass_k: str | Sequence[int] | None = None) -> DataFrame:
    """``benchmark, syntax_rate, pass_at_k, codebleu`` as ``metrics_report`` gives them for all merged rows."""
    state = read_state(spark, root)
    if state is None:
        raise FileNotFoundError(f"No report state at {root}.")
    by = ["benchmark"]
    scores = mean_pass_at_k(state["counts"], parse_k(pass_k), by)
    report = code_bleu_of(state["ngrams"], state["shapes"], by).join(pass_map(scores, by), by, "full")
    return report.select("benchmark", "syntax_rate", "pass_at_k", "codebleu")
