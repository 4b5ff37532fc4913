"""SimHash near-duplicates, compared by bit planes.

Fingerprints that may be near share a slot: with 3 differing bits in 5 blocks, two blocks
agree. Within a slot the fingerprints are turned into 64 bit planes; a query is compared with
64 of them per machine word, its distances growing in carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.batches import text_slices, texts_of
from promptmill.llm.components import components
from promptmill.sinks.scratch import scratch_table

BITS = 64
SEED = 42
# Fingerprints of one slot that one task compares with as many others.
SLOT_ROWS = 4096
# Queries compared side by side, and bit planes between two looks for an early end.
QUERIES, PLANES = 64, 8
# Slots of at most so many points are compared together, so many pairs at once.
SMALL, PAIRS = 32, 4096
# Rows of slots that are compared in one turn.
TURN_ROWS = 1 << 16
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words, or of the whole sequence if it is shorter."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda end, size: end + 1 + size))
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[words - 1 :] or ends[-1:]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, last)), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """``id_column, mark, fingerprint``, one row per input row; a map without a shuffle.

    The fingerprint is a signed BIGINT. A text without words, and a null text, has 0. ``mark``
    is a hash of the text, which tells rows with equal ids apart.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column):
                found = [majority(shingle_hashes(t, words)) for t in texts_of(part, text_column)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column("_mark"), pa.array(found, pa.int64())],
                    [id_column, "mark", "fingerprint"],
                )

    rows = docs.select(id_column, text_column, text_mark(text_column).alias("_mark"))
    schema = f"`{id_column}` {dict(rows.dtypes)[id_column]}, mark bigint, fingerprint bigint"
    return rows.mapInArrow(scan, schema)


def text_mark(text_column: str) -> Column:
    return F.xxhash64(F.lit(7), F.col(f"`{text_column}`"))


def slots_of(point: Column, radius: int) -> Column:
    """The slots of a fingerprint: one for each two of ``radius + 2`` blocks, and their bits."""
    blocks = radius + 2
    edges = [BITS * k // blocks for k in range(blocks + 1)]

    def bits(k: int) -> Column:
        width = edges[k + 1] - edges[k]
        return F.shiftrightunsigned(point, edges[k]).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(
        *[
            F.lit(number << 40)
            .bitwiseOR(F.shiftleft(bits(i), edges[j + 1] - edges[j]))
            .bitwiseOR(bits(j))
            for number, (i, j) in enumerate(combinations(range(blocks), 2))
        ]
    )


def planes_of(points: np.ndarray) -> np.ndarray:
    """64 rows of machine words; bit n of row k is bit k of point n. Padded with zero points."""
    padded = np.zeros(-(-points.size // 64) * 64, "<u8")
    padded[: points.size] = points
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """Boolean matrix: which of the ``lanes`` points differ from each query in ``radius`` bits at most.

    Counters hold distances modulo a power of two above the radius; what overflows is too
    far. The block is abandoned once every lane of every query is.
    """
    width = planes.shape[1]
    masks = np.where(np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), ALL, 0)
    counters = [np.zeros((queries.size, width), np.uint64) for _ in range(radius.bit_length())]
    far = np.zeros((queries.size, width), np.uint64)
    spare = width * 64 - lanes
    if spare:
        far[:, -1] = ALL << np.uint64(64 - spare)
    for k in range(BITS):
        carry = planes[k][None, :] ^ masks[:, k, None]
        for counter in counters:
            over = counter & carry
            counter ^= carry
            carry = over
        far |= carry
        if k % PLANES == PLANES - 1 and (far == ALL).all():
            return np.zeros((queries.size, lanes), bool)
    # Beyond the radius although nothing overflowed: compare the counters with it, high bit first.
    above, equal = np.zeros_like(far), np.full_like(far, ALL)
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    near = np.ascontiguousarray(~(far | above))
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :lanes].astype(bool)


def near_forest(queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of linked points: a forest that connects what near pairs connect.

    ``queries`` are compared with ``lanes``; both are the same array for pairs inside it.
    """
    same = queries is lanes
    points = lanes if same else np.concatenate([lanes, queries])
    label = np.arange(points.size)
    planes = planes_of(lanes)
    for at in range(0, queries.size, QUERIES):
        near = within(queries[at : at + QUERIES], planes, lanes.size, radius)
        for row in np.flatnonzero(near.sum(axis=1) > int(same)).tolist():
            own = at + row + (0 if same else lanes.size)
            met = np.unique(np.append(label[: lanes.size][near[row]], label[own]))
            if met.size > 1:
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(points.size))
    return points[linked], points[label[linked]]


def near_pairs(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``near_forest`` of many small groups at once, each ``sizes`` points from ``starts`` on.

    The differing bits of all pairs of all groups are the lanes, compared with nothing: one
    machine word counts 64 pairs, whichever groups they are from.
    """
    none = np.zeros(0, np.int64)
    pairs = [(none, none)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        begin = starts[sizes == size][:, None]
        pairs.append(tuple((begin + side).ravel() for side in np.triu_indices(size, 1)))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    near = np.zeros(a.size, bool)
    for low in range(0, a.size, PAIRS):
        left, right = a[low : low + PAIRS], b[low : low + PAIRS]
        near[low : low + PAIRS] = within(np.zeros(1, np.uint64), planes_of(points[left] ^ points[right]), left.size, radius)[0]
    root: dict[int, int] = {}
    links: list[tuple[int, int]] = []
    for pair in zip(a[near].tolist(), b[near].tolist()):
        a, b = (_root(root, n) for n in pair)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append(pair)
    linked = np.array(links, np.int64).reshape(-1, 2)
    return points[linked[:, 0]], points[linked[:, 1]]


def _root(root: dict[int, int], node: int) -> int:
    while node in root:
        node = root[node]
    return node


def near_links(
    points: DataFrame, radius: int = 3, slot_rows: int = SLOT_ROWS, slots: Column | None = None
) -> DataFrame:
    """``a, b``: links that connect all points within ``radius`` bits, and no others.

    The first column of ``points`` is a BIGINT of distinct values. With ``slots``, an array
    column of ``points``, only points with a slot in common are compared, whatever their bits
    are; a value may then come with several arrays. A slot with more than ``slot_rows``
    points is dealt out in shares, and each two shares meet in a task of their own, so no
    task holds more than two shares and no pair is left out. A task sends on a forest, at
    most one link per point, however many pairs are near.
    """
    point = F.col(points.columns[0])
    placed = points.select(
        point.alias("point"), F.explode(slots_of(point, radius) if slots is None else slots).alias("slot")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, point, starts, large in _whole_slots(batches, slot_rows):
            sizes = np.diff(np.append(starts, slot.size))
            small = ~large & (sizes <= SMALL)
            found = [near_pairs(point, starts[small], sizes[small], radius)]
            for n in np.flatnonzero(~large & ~small).tolist():
                lanes = point[starts[n] : starts[n] + sizes[n]]
                found.append(near_forest(lanes, lanes, radius))
            a, b = (np.concatenate([f[side] for f in found]) for side in (0, 1))
            rest = np.repeat(large, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, point[rest]]).view(np.int64)),
                    pa.array(np.concatenate([b, point[rest]]).view(np.int64)),
                    pa.concat_arrays([pa.nulls(a.size, pa.int64()), pa.array(slot[rest])]),
                ],
                ["a", "b", "slot"],
            )

    compared = scratch_table(
        placed.repartition("slot")
        .sortWithinPartitions("slot")
        .withColumn("slot", F.col("slot").cast("bigint"))
        .mapInArrow(compare, "a bigint, b bigint, slot bigint")
    )
    dealt = compared.filter("slot IS NOT NULL").select("slot", F.col("a").alias("point"))
    links = compared.filter("slot IS NULL").select("a", "b")
    return links.unionByName(_links_of_large(dealt, radius, slot_rows)).distinct()


def _whole_slots(
    batches: Iterator[pa.RecordBatch], slot_rows: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slots and points of rows in order of slot, where each slot begins, and which are large.

    The rows of a large slot, one with more than ``slot_rows`` rows, may come in several turns;
    those of any other come together.
    """
    beyond: int | None = None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            waiting.append((batch.column("slot").to_numpy(), batch.column("point").to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count < TURN_ROWS:
                continue
        if not count:
            continue
        slot, point = (np.concatenate(side) for side in zip(*waiting))
        starts = np.append(0, np.flatnonzero(np.diff(slot)) + 1)
        large = np.diff(np.append(starts, slot.size)) > slot_rows
        if beyond is not None:
            large[0] |= slot[0] == beyond
        beyond = int(slot[-1]) if large[-1] else None
        # The last slot may go on in the next batch.
        end = slot.size if batch is None or large[-1] else int(starts[-1])
        waiting, count = [(slot[end:], point[end:])], slot.size - end
        if end:
            kept = starts < end
            yield slot[:end], point[:end], starts[kept], large[kept]


def _links_of_large(placed: DataFrame, radius: int, slot_rows: int) -> DataFrame:
    """``a, b``: ``near_links`` of slots whose points are dealt out in shares."""
    sizes = placed.groupBy("slot").agg(F.count("point").alias("count"))
    shares = F.ceil(F.col("count") / F.lit(slot_rows)).cast("int")
    dealt = placed.join(sizes, "slot").select("slot", "point", shares.alias("shares")).withColumn(
        "share", F.pmod(F.xxhash64("point"), F.col("shares")).cast("int")
    )
    meets = F.transform(
        F.sequence(F.lit(0), F.col("shares") - 1),
        lambda other: F.struct(F.least("share", other).alias("i"), F.greatest("share", other).alias("j")),
    )
    groups = (
        dealt.withColumn("meet", F.explode(meets))
        .groupBy("slot", "meet")
        .agg(F.collect_list(F.when(F.col("share") == F.col("meet.i"), F.col("point"))).alias("left"),
             F.collect_list(F.when(F.col("share") == F.col("meet.j"), F.col("point"))).alias("right"))
        .select("left", "right", (F.col("meet.i") == F.col("meet.j")).alias("inside"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, inside in zip(*(batch.column(c) for c in ("left", "right", "inside"))):
                lanes = right.values.to_numpy().view(np.uint64)
                queries = lanes if inside.as_py() else left.values.to_numpy().view(np.uint64)
                a, b = near_forest(queries, lanes, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return groups.mapInArrow(compare, "a bigint, b bigint")


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """``id_column, mark, fingerprint, group, component_id``, one row per input row.

    Rows whose fingerprints differ in ``radius`` bits or less are linked; ``group`` is the
    smallest fingerprint a row can reach over links, ``component_id`` the smallest id. Null
    and empty texts have fingerprint 0 and are linked like any other; null ids are left out
    of the smallest id, which is null if a group has no other; rows with equal ids each get
    their row; other columns are ignored; an empty table gives an empty table.

    Equal fingerprints are one point with its smallest id, so copies cost one row. Only
    fingerprints move; texts stay where they are read.
    """
    marked = scratch_table(fingerprints(docs, id_column, text_column, words))
    points = scratch_table(marked.groupBy("fingerprint").agg(F.min(id_column).alias("least")))
    roots = components(near_links(points.select("fingerprint"), radius))
    grouped = points.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("group")
    )
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    labelled = grouped.join(least, "group").select("fingerprint", "group", "component_id")
    return marked.join(labelled, "fingerprint").select(id_column, "mark", "fingerprint", "group", "component_id")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each of ``near_groups``'s groups.

    That is the row with the smallest id (a null id is the smallest), then the smallest hash
    of the text, then the smallest other columns.
    """
    return keep_first(docs, near_groups(docs, id_column, text_column, words, radius), id_column, text_column)


def keep_first(docs: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The first row of each group; ``groups`` has ``id_column, mark, group`` of every row."""
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col(id_column).alias("id"), "mark")).alias("__kept"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*columns, text_mark(text_column).alias("__mark"))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("__kept.id")) & (F.col("__mark") == F.col("__kept.mark"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_column, text_column)]
    first = F.row_number().over(Window.partitionBy(f"`{id_column}`", "__mark").orderBy(*others or [F.col("__mark")]))
    chosen = marked.join(kept.select("__kept"), same, "left_semi").withColumn("__first", first)
    return chosen.filter("__first = 1").select(*columns)
