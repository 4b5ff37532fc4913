"""The row that follows each row in id order, without a sort in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.sinks.scratch import scratch_table

# Ids of one bucket, and buckets linked together.
SPAN = 1024
BUCKETS = 4096
# Rows without an id come before all others, in buckets of their own by a hash of the text.
_NO_ID, _NO_ID_SHIFT = -(1 << 58), 50


def with_successor(
    rows: DataFrame,
    measures: dict[str, Callable[[Column], Column]],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column``, ``measures`` of the text, and as ``next_...`` those of the next row's text.

    Rows are in ascending order of a whole-number id, nulls first, then of a hash of the text;
    behind the last row comes the first, so the next of a single row is itself. Ids are cut
    into spans; each span also gets the first row of the next span that has rows, so one
    shuffle by span is all that texts go through. A measure is computed once per row.
    """
    ident, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    mark = F.xxhash64(text)
    bucket = F.when(ident.isNull(), F.shiftright(mark, _NO_ID_SHIFT) + _NO_ID).otherwise(
        F.floor(ident / F.lit(SPAN)).cast("bigint")
    )
    keyed = rows.select(ident.cast("bigint").alias("_id"), text.alias("_text"), bucket.alias("_bucket"))
    heads = _with_previous(keyed.groupBy("_bucket").agg(F.min("_id").alias("_head")))
    borrowed = keyed.join(
        heads.select(F.col("_bucket").alias("_own"), "_head", "_previous"),
        (F.col("_bucket") == F.col("_own")) & F.col("_id").eqNullSafe(F.col("_head")),
    ).select("_id", "_text", F.col("_previous").alias("_bucket"), F.lit(1).alias("_extra"))
    order = Window.partitionBy("_bucket").orderBy("_extra", F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    return (
        keyed.select("_id", "_text", "_bucket", F.lit(0).alias("_extra"))
        .unionByName(borrowed)
        .select("*", *[measure(F.col("_text")).alias(name) for name, measure in measures.items()])
        .withColumns({f"next_{name}": F.lead(name).over(order) for name in measures})
        .filter("_extra = 0")
        .select(F.col("_id").alias(id_column), *measures, *[f"next_{name}" for name in measures])
    )


def _with_previous(heads: DataFrame) -> DataFrame:
    """``_bucket, _head, _previous``: the bucket before each, before the first the last.

    Only every 4096th bucket's neighbours are looked up in one task. The table has a row per
    bucket and is written, so that Spark knows its size when it chooses the join.
    """
    grouped = heads.withColumn("_group", F.floor(F.col("_bucket") / F.lit(BUCKETS)))
    ends = grouped.groupBy("_group").agg(F.max("_bucket").alias("_end"))
    everything = Window.orderBy("_group")
    last = F.max("_end").over(Window.partitionBy())
    before = ends.select("_group", F.coalesce(F.lag("_end").over(everything), last).alias("_end_before"))
    inside = Window.partitionBy("_group").orderBy("_bucket")
    linked = grouped.withColumn("_lag", F.lag("_bucket").over(inside)).join(before, "_group")
    return scratch_table(linked.select("_bucket", "_head", F.coalesce("_lag", "_end_before").alias("_previous")))
