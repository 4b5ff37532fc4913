"""One JSON array file read by many tasks.

The file is read with Spark's text reader, records cut at every comma, so its splits go to many
tasks. A record's effect on the JSON lexer depends on one thing only: whether it begins inside a
string (a comma ends any escape, so no record begins after a backslash). For both cases a task
computes, vectorised over a batch, the parity of its unescaped quotes and the change of depth
made by brackets outside strings; running sums give the same for every record relative to its
split. Splits are then chained in file order (a window over one row per split): the state and
depth at a split's start. A comma outside strings at depth 1 ends an element. Elements are
numbered in file order, their records joined again and parsed by ``from_json``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.sinks.scratch import scratch_table

SEPARATOR = ","
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_OPEN, _CLOSE = (ord("["), ord("{")), (ord("]"), ord("}"))

_SUMMARY = "file string, block bigint, at bigint, value string, parity_after int, depth0 bigint, depth1 bigint"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per record, relative to its split: quote parity after it, and depth after it if the split
    began outside (``depth0``) or inside (``depth1``) a string. Records of a split come in order,
    in one task; what a split has so far is carried from batch to batch."""
    carried: tuple | None = None  # (file, block, parity, depth0, depth1) after the last record
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        values = batch.column("value")
        wide = pa.types.is_large_string(values.type)
        offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
        data = values.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        record = np.repeat(np.arange(n), lengths)
        at = np.arange(buf.size)
        # A quote is escaped by an odd run of backslashes right before it, within its record.
        last_plain = np.maximum.accumulate(np.where(buf != _BACKSLASH, at, -1)) if buf.size else at
        before = np.maximum(np.concatenate([[-1], last_plain[:-1]]), starts[record] - 1) if buf.size else at
        quotes = (buf == _QUOTE) & ((at - 1 - before) % 2 == 0)
        running = np.concatenate([[0], np.cumsum(quotes)])
        inside = (running[:-1] - running[starts][record]) % 2  # in a string before the byte, for a record begun outside
        step = np.isin(buf, _OPEN).astype(np.int64) - np.isin(buf, _CLOSE)
        d_out = np.bincount(record, weights=step * (inside == 0), minlength=n).astype(np.int64)
        d_in = np.bincount(record, weights=step * (inside == 1), minlength=n).astype(np.int64)
        p = (running[starts + lengths] - running[starts]) % 2
        # Splits within the batch: runs of equal (file, block).
        files, blocks = batch.column("file"), np.asarray(batch.column("block"))
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = np.asarray(pc.not_equal(files.slice(1), files.slice(0, n - 1)).fill_null(True)) | (blocks[1:] != blocks[:-1])
        first_key = (files[0].as_py(), int(blocks[0]))
        init = carried[2:] if carried and carried[:2] == first_key else (0, 0, 0)
        new[0] = True
        seg = np.cumsum(new) - 1
        seg_start = np.flatnonzero(new)
        first_seg = seg == 0
        cp = np.cumsum(p)
        parity_before = (cp - p - (cp - p)[seg_start][seg] + np.where(first_seg, init[0], 0)) % 2
        out = []
        for e in (0, 1):
            delta = np.where((e ^ parity_before) == 1, d_in, d_out)
            cs = np.cumsum(delta)
            out.append(cs - (cs - delta)[seg_start][seg] + np.where(first_seg, init[1 + e], 0))
        parity_after = parity_before ^ p
        carried = (files[n - 1].as_py(), int(blocks[n - 1]), int(parity_after[-1]), int(out[0][-1]), int(out[1][-1]))
        yield pa.RecordBatch.from_arrays(
            [files, batch.column("block"), batch.column("at"), values,
             pa.array(parity_after.astype(np.int32)), pa.array(out[0]), pa.array(out[1])],
            names=["file", "block", "at", "value", "parity_after", "depth0", "depth1"],
        )


def array_elements(spark: SparkSession, files: list[str], schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """``file, element`` and the fields of ``schema``: each element of each top-level array, in file order.

    Equal to ``spark.read.json(files, multiLine=True)`` on array files, malformed elements failing
    as there (FAILFAST). An empty array gives no rows. One difference: an object or array read
    into a *string* field comes back compact here (``from_json`` writes it anew), where the
    multi-line reader keeps the file's own spacing.
    """
    records = spark.read.option("lineSep", SEPARATOR).text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # Written once: running ids and the split's records stay as they were read.
    summary = scratch_table(records.mapInArrow(_summaries, _SUMMARY))
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = summary.groupBy("file", "block").agg(
        F.max_by(F.struct("parity_after", "depth0", "depth1"), "at").alias("end"), F.max("at").alias("last_at")
    )
    splits = splits.withColumn("entry", F.coalesce(F.sum("end.parity_after").over(by_file), F.lit(0)) % 2)
    splits = splits.withColumn("moved", F.when(F.col("entry") == 0, F.col("end.depth0")).otherwise(F.col("end.depth1")))
    splits = splits.select(
        "file", "block", "entry", "last_at",
        F.coalesce(F.sum("moved").over(by_file), F.lit(0)).alias("depth_in"),
        (F.col("block") == F.max("block").over(Window.partitionBy("file"))).alias("last_split"),
    )
    placed = summary.join(splits, ["file", "block"]).select(
        "file", "block", "at", "value",
        ((F.col("entry") + F.col("parity_after")) % 2).alias("inside"),
        (F.col("depth_in") + F.when(F.col("entry") == 0, F.col("depth0")).otherwise(F.col("depth1"))).alias("depth"),
        (F.col("last_split") & (F.col("at") == F.col("last_at"))).alias("last"),
    )
    ends = ((F.col("inside") == 0) & (F.col("depth") == 1) & ~F.col("last")).cast("int")
    in_split = Window.partitionBy("file", "block").orderBy("at")
    marked = placed.withColumn("ends", ends).withColumn(
        "before", F.coalesce(F.sum("ends").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    counts = placed.groupBy("file", "block").agg(F.sum(ends).alias("n_ends"))
    offsets = counts.select(
        "file", "block", F.coalesce(F.sum("n_ends").over(by_file), F.lit(0)).alias("offset")
    )
    numbered = marked.join(offsets, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("before")).alias("element"), "block", "at", "value", "last"
    )
    grouped = numbered.groupBy("file", "element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda r: r["value"]), SEPARATOR).alias("text"),
        F.max("last").alias("last"),
    )
    text = F.when(F.col("element") == 0, F.regexp_replace("text", r"^[\s\uFEFF]*\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.regexp_replace(text, r"\][\s]*$", "")).otherwise(text)
    elements = grouped.select("file", "element", text.alias("text")).where(F.trim("text") != "")
    parsed = elements.select("file", "element", F.from_json("text", schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row"))
    return parsed.select("file", "element", "row.*")
