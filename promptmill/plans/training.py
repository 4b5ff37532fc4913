"""The whole preparation of training data: scan to train and validation tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.tokens import check_cutoff
from promptmill.operators import ordering, rows
from promptmill.sinks.scratch import scratch_table
from promptmill.sinks.tables import prepared_table
from promptmill.sources import paths
from promptmill.functions.text import strip
from promptmill.sources.datasets import CORRUPT, POSITION, read_dataset, read_schema
from promptmill.sources.registry import DatasetSpec, dataset_names, load_registry, resolve_dataset

# Digits of a dataset's and of a row's number in a row id, so that ids sort like numbers.
DATASET_DIGITS, ROW_DIGITS, PIECE_DIGITS = 6, 19, 10


@dataclass(frozen=True)
class PreparationOptions:
    """Settings of one preparation run, with the usual defaults."""

    dataset: str | list[str]
    dataset_dir: str = "data"
    max_samples: int | None = None
    cutoff_len: int = 4096
    val_size: float = 0.0
    seed: int = 42
    reuse_source: bool = True
    load_tokenizer: Callable[[], rows.Encoder] | None = None
    cache_path: str | None = None
    overwrite_cache: bool = False
    # Lenient runs: rows that would fail the job are written here instead (dataset, row_number, reason).
    quarantine_path: str | None = None
    # User hooks, loaded once per task on the executors (see ``rows.apply_hooks``).
    load_filter: Callable[[], rows.FilterHook] | None = None
    load_splitter: Callable[[], rows.SplitHook] | None = None
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        check_cutoff(self.cutoff_len)
        if self.val_size < 0:
            raise ValueError(f"A validation part cannot have a negative size: val_size={self.val_size}.")
        object.__setattr__(self, "names", dataset_names(self.dataset))


def format_dataset(
    spark: SparkSession, spec: DatasetSpec, options: PreparationOptions, counts: rows.StageCounts | None = None
) -> DataFrame:
    """Scan, filter, first N in file order, map, number, drop blank rows.

    With ``counts``, the mapped rows (``raw``) and those not blank (``not_blank``) are counted
    by the passes that make them. In a lenient run (``quarantine_path``) a malformed source row
    is kept with a ``reason``, passes the filter and the blank test, and counts as raw only.
    """
    lenient = options.quarantine_path is not None
    clean = F.col("reason").isNull() if lenient else None

    def mark(frame: DataFrame, stage: str, where: Column | None = None) -> DataFrame:
        return counts.mark(frame, spec.name, stage, where) if counts else frame

    scanned = read_dataset(spark, spec.path, read_schema(spec), with_position=True, lenient=lenient)
    broken = F.col(CORRUPT).isNotNull() if lenient else None
    kept = rows.row_filter(scanned, spec.row_filter, broken)
    kept = ordering.head_n(kept, POSITION, options.max_samples)
    keep = list(POSITION)
    if lenient:
        reason = F.when(broken, F.concat(F.lit("Malformed JSON: "), F.substring(CORRUPT, 1, 200)))
        kept, keep = kept.withColumn("reason", reason), [*keep, "reason"]
    mapped = mark(rows.map_columns(kept, spec, keep, options.reuse_source), "raw")
    numbered = ordering.number_rows(mapped, POSITION[:2])
    if not lenient:
        formatted = mark(rows.drop_blank(numbered.select("row_number", "user_prompt", "assistant_response")), "not_blank")
        return _hooked(formatted, options)
    present = (strip("user_prompt") != "") & (strip("assistant_response") != "")
    selected = numbered.select(
        "row_number",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("user_prompt", "assistant_response")],
        "reason",
    ).filter(F.col("reason").isNotNull() | present)
    if options.load_filter or options.load_splitter:
        raise ValueError("User hooks and a quarantine table cannot be combined yet.")
    return mark(selected, "not_blank", clean)


def _hooked(formatted: DataFrame, options: PreparationOptions) -> DataFrame:
    """The user's filter and splitter, if any; ``piece`` numbers the rows a splitter makes of one row."""
    if not (options.load_filter or options.load_splitter):
        return formatted
    return rows.apply_hooks(formatted, ["row_number"], options.load_filter, options.load_splitter)


def tokenize(
    formatted: DataFrame, options: PreparationOptions, keep: Sequence[str], counts: rows.StageCounts | None = None, name: str = ""
) -> DataFrame:
    lenient = options.quarantine_path is not None
    carried = [*keep, "reason"] if lenient else list(keep)
    if options.load_tokenizer is None:
        encoded = rows.encode(formatted, carried)
    else:
        encoded = rows.encode_with(formatted, options.load_tokenizer, carried)
    if lenient:
        supervised = rows.supervise_or_reject(encoded, options.cutoff_len, keep)
        return counts.mark(supervised, name, "supervised", F.col("reason").isNull()) if counts else supervised
    supervised = rows.supervise(encoded, options.cutoff_len, keep)
    return counts.mark(supervised, name, "supervised") if counts else supervised


def build_rows(spark: SparkSession, options: PreparationOptions, counts: rows.StageCounts | None = None) -> DataFrame:
    """All datasets of the run, tokenised and concatenated.

    The row id orders rows by dataset and file position and depends on the data alone.
    """
    registry = load_registry(spark, options.dataset_dir)
    specs = [resolve_dataset(spark, registry, options.dataset_dir, name) for name in options.names]
    hooked = bool(options.load_filter or options.load_splitter)
    keep = ["row_number", "piece"] if hooked else ["row_number"]
    parts = [
        (spec.name, tokenize(format_dataset(spark, spec, options, counts), options, keep, counts, spec.name))
        for spec in specs
    ]
    numbers = [F.lpad(F.col("dataset_order").cast("string"), DATASET_DIGITS, "0"), F.lpad(F.col("row_number").cast("string"), ROW_DIGITS, "0")]
    if hooked:
        # Rows a splitter made of one row follow it in order.
        numbers.append(F.lpad(F.col("piece").cast("string"), PIECE_DIGITS, "0"))
    row_id = F.concat_ws(":", *numbers)
    extra = ["reason"] if options.quarantine_path is not None else []
    return ordering.concat_datasets(parts).select(
        row_id.alias("row_id"), "dataset", "input_ids", "labels", "attention_mask", *extra
    )


def identity(spark: SparkSession, options: PreparationOptions) -> str:
    """A digest of what prepared rows depend on: specs, files, limits and the tokenizer's code."""
    registry = load_registry(spark, options.dataset_dir)
    specs = [resolve_dataset(spark, registry, options.dataset_dir, name) for name in options.names]
    files = [paths.signature(spark, spec.path) for spec in specs]
    code = b"".join(cloudpickle.dumps(f) if f else b"" for f in (options.load_tokenizer, options.load_filter, options.load_splitter))
    parts = (specs, files, options.max_samples, options.cutoff_len, options.reuse_source, options.quarantine_path is not None)
    return hashlib.sha256(repr(parts).encode() + code).hexdigest()


def prepare_training_data(spark: SparkSession, options: PreparationOptions) -> DataFrame:
    """``row_id, dataset, input_ids, labels, attention_mask, split``.

    Tokenising is the costly step, so its result is written once: to ``cache_path``,
    where a later run finds it again, or to the scratch folder. Splitting then only reads
    the row id.
    """
    return prepare_with_counts(spark, options)[0]


COUNTS_SCHEMA = "dataset string, stage string, n_rows bigint"


def prepare_with_counts(spark: SparkSession, options: PreparationOptions) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Prepared rows as ``prepare_training_data`` gives them, and ``(dataset, stage, n_rows)``.

    Stages are ``raw`` (mapped rows), ``not_blank`` and ``supervised``; they are counted by the
    passes that make the rows (see ``rows.StageCounts``). A run that builds a cached table writes
    the counts beside it (``<cache_path>.counts``); a run that reuses the table reads them from
    there (none if a run stopped between the two writes).
    """
    counts = rows.StageCounts()
    built: list[bool] = []
    lenient = options.quarantine_path is not None
    flag = "quarantined" if lenient else None

    def build() -> DataFrame:
        built.append(True)
        made = build_rows(spark, options, counts)
        return made.withColumn(flag, F.col("reason").isNotNull()) if lenient else made

    if options.cache_path:
        prepared = prepared_table(spark, options.cache_path, build, identity(spark, options), options.overwrite_cache, flag)
        beside = f"{options.cache_path.rstrip('/')}.counts"
        if built:
            found = counts.result()
            spark.createDataFrame(found, COUNTS_SCHEMA).coalesce(1).write.mode("overwrite").json(beside)
        elif paths.exists(spark, f"{beside}/_SUCCESS"):
            found = [tuple(r) for r in spark.read.schema(COUNTS_SCHEMA).json(beside).collect()]
        else:
            found = []
    else:
        prepared = scratch_table(build(), partition_by=flag)
        found = counts.result()
    if lenient:
        # Rows and rejects were written once, apart by the partition column; rejects are copied out.
        rejected = prepared.where(F.col(flag)).select(
            "dataset", F.substring_index("row_id", ":", -1).cast("bigint").alias("row_number"), "reason"
        )
        rejected.write.mode("overwrite").parquet(options.quarantine_path)
        prepared = prepared.where(~F.col(flag)).drop(flag, "reason")
    return ordering.label_split(prepared, "row_id", options.val_size, options.seed), found


def load_and_prepare(
    spark: SparkSession, options: PreparationOptions
) -> tuple[DataFrame, DataFrame | None]:
    """Shuffled training rows, and validation rows unless ``val_size`` is zero."""
    labelled = prepare_training_data(spark, options)
    shuffled = ordering.seeded_shuffle(labelled, "row_id", options.seed)
    train = shuffled.filter(F.col("split") == "train").drop("split")
    if options.val_size == 0:
        return train, None
    return train, shuffled.filter(F.col("split") == "test").drop("split")
