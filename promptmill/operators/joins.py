"""Joining a large table with a usually small one, safely when it is not small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.sinks.scratch import scratch_table

# Text a broadcast side may hold.
BROADCAST_BYTES = 64 << 20
# Rows of one key that one task may have to join.
ROWS_PER_TASK = 2_000_000


def measured_bytes(rows: DataFrame) -> int:
    """Bytes of the rows rendered as text, measured rather than estimated."""
    width = F.octet_length(F.to_json(F.struct("*")))
    return rows.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    identity: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join that shuffles nothing while the small side's measured size allows it.

    Beyond that both sides are shuffled, and a key with more than ``rows_per_task`` rows
    is cut into as many shares as it needs: its large rows are dealt out by a hash of
    ``identity``, its small rows are copied once per share.
    """
    on = list(on)
    # Written, so that measuring it and joining it compute it once.
    small = scratch_table(small)
    if measured_bytes(small) <= broadcast_bytes:
        return large.join(F.broadcast(small), on)
    # Written, so that Spark knows its size; it has a row per rows_per_task rows at most.
    hot = scratch_table(
        large.groupBy(*on)
        .count()
        .filter(F.col("count") > rows_per_task)
        .select(*on, F.ceil(F.col("count") / F.lit(rows_per_task)).alias("_shares"))
    )
    shares = F.coalesce("_shares", F.lit(1))
    dealt = large.join(hot, on, "left").withColumn(
        "_share", F.pmod(F.xxhash64(*identity), shares)
    )
    copied = small.join(hot, on, "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares.cast("bigint") - F.lit(1)))
    )
    return dealt.drop("_shares").join(copied.drop("_shares"), [*on, "_share"]).drop("_share")
