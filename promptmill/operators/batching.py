"""Padded training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions.tokens import IGNORE_INDEX, pad_to
from promptmill.operators.ordering import rank_buckets, shuffle_buckets


def batch_pad(
    rows: DataFrame,
    key: str,
    batch_size: int,
    pad_id: int,
    seed: int = 42,
    multiple_of: int | None = None,
) -> DataFrame:
    """Rows of the seeded order cut into batches and right-padded to the batch maximum.

    ``key`` identifies rows. ``multiple_of`` rounds the padded length up, as
    half-precision training wants it.
    The token arrays are shuffled once, by ranking bucket. A batch inside one bucket finds
    its maximum there. Batches that reach over a bucket's edge, at most one per bucket,
    are measured from the key and the length alone and broadcast.
    """

    def batched(source: DataFrame) -> DataFrame:
        ranked = rank_buckets(shuffle_buckets(source, key, seed), key, "position")
        return ranked.select("*", F.floor(F.col("position") / F.lit(batch_size)).alias("batch_id"))

    lengths = rows.select(key, F.size("input_ids").alias("_length"))
    crossing = (
        batched(lengths)
        .groupBy("batch_id")
        .agg(F.max("_length").alias("_across"), F.min("_bucket").alias("_low"), F.max("_bucket").alias("_high"))
        .filter(F.col("_low") < F.col("_high"))
        .select("batch_id", "_across")
    )
    inside = F.max(F.size("input_ids")).over(Window.partitionBy("_bucket", "batch_id"))
    measured = batched(rows).select("*", inside.alias("_inside")).join(F.broadcast(crossing), "batch_id", "left")
    step = multiple_of or 1
    longest = F.coalesce("_across", "_inside")
    width = (F.ceil(longest / F.lit(step)) * F.lit(step)).cast("int")
    length = F.col("padded_len")
    padded = {
        "input_ids": pad_to("input_ids", length, pad_id),
        "labels": pad_to("labels", length, IGNORE_INDEX),
        "attention_mask": pad_to("attention_mask", length, 0),
    }
    return (
        measured.withColumn("padded_len", width)
        .drop("_value", "_bucket", "_inside", "_across")
        .withColumns(padded)
    )
