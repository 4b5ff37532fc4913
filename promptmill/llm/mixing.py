"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot n of the mix draws its source from the n-th van der Corput point, mapped through the
cumulative weights, so every stretch of the mix holds every source in its share. The r-th
slot of a source takes the r-th block of its shuffled words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.sinks.scratch import scratch_table

WORD = r"[^\x20\x09-\x0D]+"
# Words of one slot.
BLOCK_WORDS = 128
# Bits of a slot number that are mirrored into a point.
POINT_BITS = 52
# Leading bits of the shuffle value that cut a source into even, separately summed runs.
RUN_BITS = 12
# Slots numbered together.
SLOT_RUN = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, place, source_size, target``: words to take from each source.

    ``sizes`` has one row per source: ``source, source_size``. Sources in code point order,
    null last, get ``weights`` in turn and share ``share`` times all words by weight. No
    target exceeds ``most`` times its source; the excess goes to the others by weight. That
    is one level L with target = least(most * size, L * weight): sources sorted by
    most * size / weight are full one after the other, so L follows from running sums. The
    windows run over one row per source.
    """
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.select(
        "source",
        "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("place"),
    ).withColumn("_weight", F.element_at(cycle, (F.col("place") % len(weights)).cast("int") + 1))
    room = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy("_full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("_full_at", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        placed.withColumn("_room", room)
        .withColumn("_full_at", F.col("_room") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_room").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(from_here))
    )
    # The first source that its level does not fill sets the level of all that follow.
    level = F.min(F.when(F.col("_level") < F.col("_full_at"), F.struct("_full_at", "place", "_level"))).over(everything)
    return levels.withColumn("_set", level["_level"]).select(
        "source",
        "place",
        "source_size",
        F.coalesce(F.least("_room", F.col("_set") * F.col("_weight")), F.col("_room")).alias("target"),
    )


def _before(order: Column, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def shuffle_key(id_column: str, text_column: str, seed: int) -> Column:
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col(f"`{id_column}`").cast("string"), text)


def lay_out(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int) -> DataFrame:
    """``doc_id, source, size, key, first``: where each document begins in its source's shuffled words.

    A source is shuffled by a hash. Its leading bits cut it into even runs, which are summed
    apart, so a source with a third of all rows is no single task's work.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    key = shuffle_key(id_column, text_column, seed)
    rows = scratch_table(
        docs.select(
            F.col(f"`{id_column}`").alias("doc_id"),
            F.col(f"`{source_column}`").alias("source"),
            word_count(text).alias("size"),
            key.alias("key"),
        ).withColumn("run", F.shiftrightunsigned("key", 64 - RUN_BITS))
    )
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("_words"))
    run_first = F.coalesce(F.sum("_words").over(_before(F.col("run"), "source")), F.lit(0))
    offsets = runs.select(F.col("source").alias("_source"), F.col("run").alias("_run"), run_first.alias("_offset"))
    inside = Window.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("run") == F.col("_run")))
        .select("doc_id", "source", "size", "key", (F.col("_offset") + F.col("_inside")).alias("first"))
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, place, rank``: the source of every slot of the mix, and its rank among that source's.

    The points are exact: a slot number's bits, mirrored. The table of sources is joined by
    the range of points each covers, laid on a grid so that only few sources meet a slot.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = -(-int(total) // block_words)
    running = F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    cells = 1024
    ranges = (
        targets.select("place", "target", (running / F.lit(total or 1.0)).alias("_to"))
        .withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("place")), F.lit(0.0)))
        .filter("target > 0")
        .select(
            "place",
            "_from",
            # Rounding must not leave a gap at the end.
            F.when(F.lead("_to").over(Window.orderBy("place")).isNull(), 2.0).otherwise(F.col("_to")).alias("_to"),
        )
        .withColumn(
            "cell",
            F.explode(
                F.sequence(
                    F.floor(F.col("_from") * cells), F.least(F.floor(F.col("_to") * cells), F.lit(cells - 1).cast("bigint"))
                )
            ),
        )
    )
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("bigint")
    drawn = (
        spark.range(slots)
        .select(F.col("id").alias("slot"))
        .withColumn("point", mirrored / F.lit(float(1 << POINT_BITS)))
        .withColumn("cell", F.floor(F.col("point") * cells))
        .join(ranges, "cell")
        .filter("point >= _from AND point < _to")
        .select("slot", "place", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    )
    counts = drawn.groupBy("place", "run").count()
    earlier = F.coalesce(F.sum("count").over(_before(F.col("run"), "place")), F.lit(0))
    offsets = counts.select("place", "run", earlier.alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    return (
        drawn.withColumn("_inside", inside)
        .join(offsets, ["place", "run"])
        .select("slot", "place", (F.col("_earlier") + F.col("_inside")).alias("rank"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    share: float = 1.5,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and what it takes of each document.

    The first table has a row per piece of the mix: ``slot, place, key, first, start, words``
    – in slot ``slot``, ``words`` words of the document at ``first`` of its source, from its
    word ``start`` on. A source's words are laid out in shuffled order and read round and
    round; its r-th slot is the words from r * block_words on, so all blocks are equal. No
    word is read more than ``most`` times, a whole number here.

    The second has a row per input row: ``doc_id, source, key, first, size, source_size,
    target, taken``. Null texts have no words; a null source is a source of its own, the last;
    rows with equal ids or texts are documents of their own; other columns are ignored; an
    empty table gives empty tables. The order depends on the seed, the ids and the texts only.
    """
    laps = int(most)
    laid = scratch_table(lay_out(docs, id_column, text_column, source_column, seed))
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch_table(source_targets(sizes, weights, share, most))
    known = targets.withColumnRenamed("source", "_source")
    rows = laid.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Each document's words in each lap, cut at the borders of blocks.
    lap = F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))
    spans = (
        rows.filter("size > 0")
        .select("place", "key", "first", "size", "source_size", lap.alias("lap"))
        .withColumn("begin", F.col("first") + F.col("lap") * F.col("source_size"))
        .withColumn("end", F.col("begin") + F.col("size"))
    )
    block = F.lit(block_words)
    cut = spans.withColumn(
        "rank",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))),
    )
    low, high = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    blocks = cut.select("place", "rank", "key", "first", (low - F.col("begin")).alias("start"), (high - low).alias("words"))
    pieces = schedule(targets, block_words).join(blocks, ["place", "rank"]).drop("rank")
    taken = pieces.groupBy("place", "first").agg(F.sum("words").alias("_taken"))
    # Documents without words share their start with the one behind them.
    counted = rows.join(taken, ["place", "first"], "left").withColumn(
        "taken", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    )
    return pieces, counted.select("doc_id", "source", "key", "first", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float],
    share: float = 1.5,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix begins to read it.

    Whole documents instead of pieces: a document enters the mix with its first word, so it
    comes 0 to ``most`` times. Documents without words do not enter. Rows with equal id and
    text are told apart by a number.
    """
    pieces, _ = mix(docs, weights, share, most, id_column, text_column, source_column, seed=seed)
    entered = pieces.filter("start = 0").groupBy("key", "place", "first").agg(F.count(F.lit(1)).alias("__copies"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("place", "first"))
    copies = entered.select(F.col("key").alias("__key"), nth.alias("__nth"), "__copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = shuffle_key(id_column, text_column, seed)
    keyed = docs.select(*columns, key.alias("__key"))
    numbered = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(f"`{source_column}`")))
    repeats = F.sequence(F.lit(1), F.col("__copies").cast("int"))
    return numbered.join(copies, ["__key", "__nth"]).withColumn("__copy", F.explode(repeats)).select(*columns)
