"""First N, seeded shuffle, exact splits and concatenation, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from promptmill.functions import permutation as P
from promptmill.functions.scores import split_size
from promptmill.functions.text import as_column
from promptmill.operators.joins import lookup_join
from promptmill.sinks.scratch import scratch_table

# Order values are the first 15 hex digits of an md5: 60 bits, a non-negative BIGINT.
HASH_DIGITS = 15
HASH_LIMIT = 16**HASH_DIGITS

# Counting bins per narrowing pass; also what such a pass returns to the driver at most.
BINS = 4096
# A bin or range of at most this many values is sorted instead of narrowed further.
SORT_BELOW = 100_000
# Ranges that keys are cut into at a time.
RANGES = 64

# Numbered rows are written in files of at most this many rows.
ROWS_PER_FILE = 100_000

# Ranking buckets are the leading bits of the order value; their offsets are broadcast,
# so this is the proven bound of that table's rows.
RANK_BITS = 16
RANK_BUCKETS = 1 << RANK_BITS


def shuffle_value(key: Column | str, seed: int) -> Column:
    """A pseudo-random order value that depends on the seed and the key only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


class Boundary(NamedTuple):
    """The ``n``-th smallest value, and how many of its ``ties`` rows belong to the first ``n``."""

    value: int
    taken: int
    ties: int


def nth_smallest(values: DataFrame, n: int | Callable[[int], int], low: int, high: int) -> Boundary | None:
    """Find the ``n``-th smallest (from 1) of a one-column BIGINT table, all in ``[low, high)``.

    Each pass counts values per equal-width bin and descends into the bin holding the
    ``n``-th. At most ``BINS`` counts reach the driver, and no pass shuffles more than
    the counts, however many rows there are and however often one value repeats. ``n``
    may be a function of the row count, which the first pass yields; 0 gives None.
    """
    value = F.col(values.columns[0])
    while True:
        width = -(-(high - low) // BINS)
        inside = values.filter((value >= low) & (value < high))
        wide = high - low >= 1 << 62
        offset = (value.cast("decimal(20,0)") if wide else value) - F.lit(low)
        counts = inside.groupBy(F.call_function("div", offset, F.lit(width)).alias("bin")).count().collect()
        if callable(n):
            n = n(sum(row["count"] for row in counts))
        if n <= 0:
            return None
        for row in sorted(counts, key=lambda r: r["bin"]):
            if n <= row["count"]:
                break
            n -= row["count"]
        else:
            raise ValueError("Fewer values than the requested rank.")
        low = low + int(row["bin"]) * width
        high = min(low + width, high)
        if width == 1:
            return Boundary(low, n, row["count"])
        if row["count"] <= SORT_BELOW:
            few = F.sort_array(F.collect_list(value))
            last = F.element_at("few", n)
            found = (
                values.filter((value >= low) & (value < high))
                .agg(few.alias("few"))
                .select(
                    last.alias("last"),
                    F.size(F.filter("few", lambda x: x < last)).alias("below"),
                    F.size(F.filter("few", lambda x: x == last)).alias("ties"),
                )
                .first()
            )
            return Boundary(found["last"], n - found["below"], found["ties"])


def _direction(name: str) -> tuple[Column, bool]:
    """A column and whether it descends; a leading minus means so."""
    return F.col(f"`{name.removeprefix('-')}`"), name.startswith("-")


def _sorted_by(order: Sequence[str]) -> list[Column]:
    return [column.desc() if down else column.asc() for column, down in map(_direction, order)]


def _up_to(order: Sequence[str], last: Row, kinds: dict[str, str]) -> Column:
    """Whether a row comes no later than ``last``; nulls come first, in a descending column last."""
    reached = F.lit(True)
    for name in reversed(order):
        (column, down), value = _direction(name), last[name.removeprefix("-")]
        here = F.lit(value).cast(kinds[name.removeprefix("-")])
        if value is None:
            before = column.isNotNull() if down else F.lit(False)
        else:
            before = column > here if down else column.isNull() | (column < here)
        same = column.isNull() if value is None else column.eqNullSafe(here)
        reached = F.coalesce(before, F.lit(False)) | (same & reached)
    return reached


def _nth_key(keys: DataFrame, order: Sequence[str], n: int) -> Row | None:
    """The ``n``-th key (from 1) of a table that holds keys alone; None if there are fewer.

    Different keys are counted and placed in ranges; the range that holds the ``n``-th is cut
    into ranges again until it is small. Keys are different, so every cut makes progress
    however often one repeats. Only a count per range, and one key, reach the driver.
    """
    counts = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_rows"))
    while True:
        ranged = counts.repartitionByRange(RANGES, *_sorted_by(order)).select("*", F.spark_partition_id().alias("_range"))
        placed = scratch_table(ranged)
        groups = placed.groupBy("_range").agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("keys")).collect()
        for group in sorted(groups, key=lambda r: r["_range"]):
            if n <= group["rows"]:
                break
            n -= group["rows"]
        else:
            return None
        counts = placed.filter(F.col("_range") == group["_range"]).drop("_range")
        if group["keys"] <= max(SORT_BELOW, RANGES):
            before = Window.orderBy(*_sorted_by(order)).rowsBetween(Window.unboundedPreceding, 0)
            reached = counts.withColumn("_reached", F.sum("_rows").over(before)).filter(F.col("_reached") >= n)
            return reached.orderBy("_reached").select(*keys.columns).first()


# Up to this n, the keys of the first n + 1 rows are taken in one pass and sent to the driver.
FIRST_ON_DRIVER = 10_000


def head_n(rows: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order``; fewer if there are fewer; all for None.

    ``order`` names columns; a leading minus turns one around. Nulls come first, in a
    descending column last. The last key of the ``n`` is found on the key columns alone,
    then the rows are filtered in a map, whatever ``n`` is: for n up to ``FIRST_ON_DRIVER`` by
    one ordered take of n + 1 keys, beyond it by counting ranges of different keys. If more rows share that key
    than fit, the order does not say which to take, and that is an error.
    """
    if n is None:
        return rows
    if n <= 0:
        return rows.limit(0)
    keys = rows.select(*[_direction(name)[0] for name in order])
    tied = ValueError(f"Rows number {n} and {n + 1} by {', '.join(order)} are tied; order by a further column.")
    if n <= FIRST_ON_DRIVER:
        # One pass: each task keeps its first n + 1 keys, and n + 1 keys (at most) reach the driver.
        firsts = keys.orderBy(*_sorted_by(order)).limit(n + 1).collect()
        if len(firsts) <= n:
            return rows
        last = firsts[n - 1]
        if tuple(firsts[n]) == tuple(last):
            raise tied
        return rows.filter(_up_to(order, last, dict(keys.dtypes)))
    last = _nth_key(keys, order, n)
    if last is None:
        return rows
    reached = _up_to(order, last, dict(keys.dtypes))
    if keys.filter(reached).count() > n:
        raise tied
    return rows.filter(reached)


def with_rank(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Position of each row (from 0) in an arbitrary order.

    A ranged sort is written once, so that retried tasks cannot move rows between
    ranges; ranks are then range offsets plus the position inside the range.
    """
    ranged = rows.select("*", F.struct(*[as_column(c) for c in order]).alias("_order"))
    placed = ranged.repartitionByRange(*[as_column(c) for c in order]).select(
        "*", F.spark_partition_id().alias("_range")
    )
    stored = scratch_table(placed)
    return _ranks_from_groups(stored, "_range", [F.col("_order")], name).drop("_order", "_range")


def shuffle_buckets(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows plus their order value and the bucket its leading bits make."""
    valued = rows.select("*", shuffle_value(key, seed).alias("_value"))
    shift = HASH_DIGITS * 4 - RANK_BITS
    return valued.select("*", F.shiftright("_value", shift).cast("int").alias("_bucket"))


def rank_buckets(bucketed: DataFrame, key: str, name: str) -> DataFrame:
    """Position of each row (from 0) in the seeded order; rows end up placed by bucket.

    Order values are uniform, so the buckets are even: one pass over the key counts them,
    one shuffle by bucket ranks inside them. Ties break on the key.
    """
    return _ranks_from_groups(bucketed, "_bucket", [F.col("_value"), F.col(key)], name)


def with_shuffle_rank(rows: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Rows plus their position (from 0) in the seeded shuffle order; ``key`` identifies rows."""
    return rank_buckets(shuffle_buckets(rows, key, seed), key, name).drop("_value", "_bucket")


def _ranks_from_groups(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Ranks over consecutive groups: rows in earlier groups plus the rank inside the group.

    The offsets hold one row per group: at most RANK_BUCKETS, or the shuffle partitions.
    """
    before = F.sum("_count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("_count"))
        .select(group, F.coalesce(before, F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return (
        rows.select("*", inside.alias("_inside"))
        .join(F.broadcast(offsets), group)
        .withColumn(name, F.col("_before") + F.col("_inside") - F.lit(1))
        .drop("_before", "_inside")
    )


def number_rows(rows: DataFrame, split_columns: Sequence[str], name: str = "row_number") -> DataFrame:
    """Consecutive numbers (from 0) in scan order, without shuffling the rows.

    ``rows`` come straight from a scan through row-local steps, or from ``head_n`` over
    such a scan, so each input split named by ``split_columns`` is one run inside one
    task. Running ids are frozen by writing the rows once; a row's number is then its
    distance from the first id of its split plus the rows of all earlier splits. The
    numbers depend on the data alone, not on how the cluster cut the files. The table of
    splits, which Spark's own scan plan holds too, is broadcast if its measured size
    allows, else joined by shuffle. Writing many files also spreads an array file, which
    one task has to parse, over many tasks from here on.
    """
    split_columns = list(split_columns)
    running = rows.select("*", F.monotonically_increasing_id().alias("_run"))
    placed = scratch_table(running, ROWS_PER_FILE)
    before = F.sum("_rows").over(
        Window.orderBy(*split_columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = (
        placed.groupBy(*split_columns)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_run").alias("_first"))
        .select(*split_columns, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    numbered = lookup_join(placed, splits, split_columns, ["_run"])
    return numbered.withColumn(name, F.col("_before") + F.col("_run") - F.col("_first")).drop(
        "_before", "_run", "_first"
    )


def seeded_shuffle(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order fixed by the seed and the key, whatever the partitioning."""
    return rows.orderBy(shuffle_value(key, seed), F.col(key))


def keyed_positions(rows: DataFrame, number: str, n: int, seed: int = 42, name: str = "position") -> DataFrame:
    """Rows plus their place (from 0) in a seeded shuffle, from dense numbers ``0 .. n-1`` in ``number``.

    A keyed bijection (``functions.permutation``) maps each number to its place in a map: no
    ranking shuffle, and the first k places (a split of exactly k rows) or place // b (a batch of
    b rows) follow at once. The walk is exact: rows whose walk has not ended after one pass get
    further passes (one check reads the place column; rarely any).
    """
    placed = rows.withColumn(name, P.walk(F.col(number), n, seed))
    while placed.where(F.col(name) >= n).limit(1).count():
        placed = placed.withColumn(name, F.when(F.col(name) >= n, P.walk(F.col(name), n, seed, first=False)).otherwise(F.col(name)))
    return placed


def label_split(rows: DataFrame, key: str, val_size: float, seed: int = 42) -> DataFrame:
    """Rows plus a ``split`` column: exactly the requested number are ``test``.

    The test part is the smallest order values under the seed. Finding the boundary
    reads the key column only and moves bin counts; labelling is a map over the rows.
    """
    value = shuffle_value(key, seed)
    found = None
    if val_size:
        found = nth_smallest(
            rows.select(value.alias("value")), lambda n: split_size(n, val_size), 0, HASH_LIMIT
        )
    if found is None:
        return rows.select("*", F.lit("train").alias("split"))
    is_test = value <= found.value
    if found.taken != found.ties:
        last_key = _last_tied_key(rows.filter(value == found.value).select(key), found)
        is_test = (value < found.value) | ((value == found.value) & (F.col(key) <= last_key))
    return rows.select("*", F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def _last_tied_key(tied: DataFrame, found: Boundary) -> Column:
    """The last test key among different keys that share the boundary value."""
    key = tied.columns[0]
    last = _nth_key(tied, [key], found.taken)[key]
    if tied.filter(F.col(key) <= F.lit(last)).count() != found.taken:
        raise ValueError(f"Several rows have the same `{key}`, so the split cannot be exact.")
    return F.lit(last)


def split(rows: DataFrame, key: str, val_size: float, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """Training rows, and validation rows unless ``val_size`` is zero."""
    labelled = label_split(rows, key, val_size, seed)
    if val_size == 0:
        return labelled.drop("split"), None
    part = F.col("split")
    return labelled.filter(part == "train").drop("split"), labelled.filter(part == "test").drop("split")


def concat_datasets(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of all parts in the order given, duplicates kept, with their origin."""
    if not parts:
        raise ValueError("There is nothing to concatenate: no dataset was given.")
    tagged = [
        rows.select(F.lit(name).alias("dataset"), F.lit(i).alias("dataset_order"), "*")
        for i, (name, rows) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, tagged)
