"""Sharding by a lookup table that shards fill in turns by their own order of preference.

Only column functions and joins: the table is one literal text, a shard is found by one
broadcast join on a slot number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots of the table, a prime: also the proven bound of what is broadcast.
SLOTS = 65_537
# Leading hex digits of the md5 that place a key: 60 bits.
KEY_DIGITS = 15


def _digest(name: str, purpose: str) -> int:
    return int(hashlib.md5(f"{purpose}:{name}".encode()).hexdigest()[:KEY_DIGITS], 16)


def fill_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (index into ``names``) of each slot.

    A shard's preferences are a permutation of the slots: an offset and a step taken from
    its name. Shards take turns, each claiming its best free slot, until none is free. Slot
    counts of two shards differ by one at most, and a shard that goes or comes moves few of
    the others' slots. ``slots`` must be a prime above the number of shards.
    """
    names = list(names)
    if not names or len(set(names)) != len(names):
        raise ValueError("Shards need names, each of its own.")
    if slots <= len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots for {len(names)} shards: a prime above their number is needed.")
    at = [_digest(n, "offset") % slots for n in names]
    step = [_digest(n, "step") % (slots - 1) + 1 for n in names]
    table = [-1] * slots
    for claim in range(slots):
        shard = claim % len(names)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        table[at[shard]] = shard
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key counts as an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("bigint") % slots


def lookup_table(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``_slot, _shard, _shard_name``: one row per slot."""
    table = F.split(F.lit(",".join(map(str, fill_table(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(table).alias("_slot", "_text")).select(
        F.col("_slot").cast("bigint").alias("_slot"),
        F.col("_text").cast("int").alias("_shard"),
        F.element_at(F.split(F.lit("\n".join(names)), "\n"), F.col("_text").cast("int") + 1).alias("_shard_name"),
    )


def place(
    rows: DataFrame,
    names: Sequence[str],
    key: str = "doc_id",
    slots: int = SLOTS,
    slot_column: str = "slot",
    shard_column: str = "shard",
    name_column: str = "shard_name",
) -> DataFrame:
    """All rows with the slot, the number and the name of their shard; existing columns of those
    names are replaced.

    Rows with equal keys go to one shard; a null key is placed like an empty text; an empty
    table stays empty. Rows are not shuffled: the lookup table has ``slots`` rows whatever the
    data, and is broadcast.
    """
    kept = [c for c in rows.columns if c not in (slot_column, shard_column, name_column)]
    column = F.col(f"`{key}`")
    table = lookup_table(rows.sparkSession, names, slots)
    placed = rows.select(*[F.col(f"`{c}`") for c in kept], slot_of(column, slots).alias("_slot"))
    return placed.join(F.broadcast(table), "_slot").select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_slot").alias(slot_column),
        F.col("_shard").alias(shard_column),
        F.col("_shard_name").alias(name_column),
    )


def write_shards(rows: DataFrame, path: str, names: Sequence[str], key: str = "doc_id", files: int = 1) -> None:
    """Parquet below ``path``, one folder per shard, ``files`` files each.

    A shard is dealt out over ``files`` tasks by a second hash of the key, so a large shard is
    never one task's work; raise ``files`` with the data.
    """
    part = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(files))
    placed = place(rows, names, key)
    dealt = placed.withColumn("_part", part).repartition(len(names) * files, "shard_name", "_part").drop("_part")
    dealt.write.mode("overwrite").partitionBy("shard_name").parquet(path)
