"""Prepared rows kept per source file, so that a new or changed file is all that is tokenised again."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.operators import ordering, rows
from promptmill.plans.training import DATASET_DIGITS, ROW_DIGITS, PreparationOptions, format_dataset, tokenize
from promptmill.sources import paths
from promptmill.sources.registry import DatasetSpec, load_registry, resolve_dataset

MANIFEST, PARTS = "_manifest", "_parts"
_MANIFEST_SCHEMA = "key string, part string, mapped bigint"


def _file_key(spec: DatasetSpec, signature: tuple[str, int, int], options: PreparationOptions) -> str:
    """What a file's tokenised rows depend on: its spec, its name, length and time, and the settings."""
    code = cloudpickle.dumps(options.load_tokenizer) if options.load_tokenizer else b""
    parts = (spec, signature, options.cutoff_len, options.reuse_source)
    return hashlib.sha256(repr(parts).encode() + code).hexdigest()


def _build_part(spark: SparkSession, spec: DatasetSpec, file: str, options: PreparationOptions, path: str) -> int:
    """Tokenised rows of one file (numbered inside the file, every row: no first-N), and its mapped rows."""
    counts = rows.StageCounts()
    single = replace(spec, path=file)
    whole = replace(options, max_samples=None, cache_path=None)
    tokenized = tokenize(format_dataset(spark, single, whole, counts), whole, ["row_number"])
    tokenized.write.mode("overwrite").parquet(path)
    return next(n for _, stage, n in counts.result() if stage == "raw")


def prepare_incremental(spark: SparkSession, options: PreparationOptions) -> tuple[DataFrame, list[str]]:
    """``row_id, dataset, input_ids, labels, attention_mask``, equal to ``build_rows``, and the files tokenised now.

    Each source file's tokenised rows are a part under ``cache_path``, named by the file's key
    (spec, name, length, time, settings, tokenizer code). The manifest of known keys is compared
    with the files there are now (a set difference on the driver, which lists the files anyway);
    only files without a part are tokenised. Rows are then numbered across files from the parts'
    counts of mapped rows, in the order a scan numbers them, and ``max_samples`` keeps the first
    rows of each dataset. Strict runs only (no quarantine, no hooks).
    """
    if not options.cache_path:
        raise ValueError("An incremental preparation needs a cache_path.")
    if options.quarantine_path or options.load_filter or options.load_splitter:
        raise ValueError("An incremental preparation takes neither a quarantine table nor hooks.")
    root = options.cache_path.rstrip("/")
    manifest = f"{root}/{MANIFEST}"
    known = {}
    if paths.exists(spark, f"{manifest}/_SUCCESS"):
        known = {r.key: (r.part, r.mapped) for r in spark.read.schema(_MANIFEST_SCHEMA).parquet(manifest).collect()}
    registry = load_registry(spark, options.dataset_dir)
    entries, built = [], []
    for order, name in enumerate(options.names):
        spec = resolve_dataset(spark, registry, options.dataset_dir, name)
        for signature in paths.signature(spark, spec.path):
            key = _file_key(spec, signature, options)
            if key not in known:
                part = f"{root}/{PARTS}/{key}"
                known[key] = (part, _build_part(spark, spec, signature[0], options, part))
                built.append(signature[0])
            entries.append((order, name, signature[0], key))
    spark.createDataFrame([(k, p, m) for k, (p, m) in known.items()], _MANIFEST_SCHEMA).coalesce(1).write.mode(
        "overwrite"
    ).parquet(manifest)
    return _assemble(spark, entries, known, options), built


def _assemble(spark: SparkSession, entries: list, known: dict, options: PreparationOptions) -> DataFrame:
    """Parts numbered across the files of each dataset: a file's offset is the mapped rows before it."""
    offsets, before, last = [], 0, None
    for order, name, file, key in entries:
        before = 0 if order != last else before
        offsets.append((order, name, key, before))
        before, last = before + known[key][1], order
    # One row per file of each dataset: what the driver's listing holds already.
    table = spark.createDataFrame(offsets, "dataset_order int, dataset string, key string, offset bigint")
    scanned = spark.read.parquet(*sorted({known[k][0] for _, _, k, _ in offsets}))
    keyed = scanned.withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), f"/{PARTS}/([0-9a-f]+)/", 1))
    placed = keyed.join(F.broadcast(table), "key")
    numbered = placed.select(
        "dataset_order", "dataset", (F.col("offset") + F.col("row_number")).alias("row_number"), "input_ids", "labels", "attention_mask"
    )
    if options.max_samples is not None:
        numbered = numbered.where(F.col("row_number") < options.max_samples)
    row_id = F.concat_ws(
        ":", F.lpad(F.col("dataset_order").cast("string"), DATASET_DIGITS, "0"), F.lpad(F.col("row_number").cast("string"), ROW_DIGITS, "0")
    )
    return numbered.select(row_id.alias("row_id"), "dataset", "input_ids", "labels", "attention_mask")
